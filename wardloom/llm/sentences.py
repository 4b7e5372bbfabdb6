"""Sentence units of texts in any language and script (problem 2).

Abbreviations, collocations and sentence starters are learned without labels, for each language, by log-likelihood
ratios over all texts (Kiss and Strunk's method); headings are learned the same way, from how often a short line stands
alone against how often longer lines begin with it. The texts are then cut into blocks by their lines, and every period of
a block is classified by these statistics. Marks of other scripts, quotations and brackets are settled by rule.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.session import cut, spread

TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.'’\-/,:]{1,2}[\p{L}\p{M}\p{N}]+)*\.?")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}][^\s]*|[^\s\p{L}\p{N}]+")
ITEM = regex.compile(r"\s*(?:[-–—•*·▪●○‣◦⁃+]|\(?(?:\d{1,3}|[٠-٩۰-۹०-९๐-๙]{1,3})[.)]|\(?[A-Za-z]\))[ \t\u00a0]+(?=\S)")
MARK = "!?؟。！？।॥۔｡‼⁇⁈⁉"
ENDS = tuple("." + MARK + "…")
ENCLOSING = re.compile(r"[\"'“”‘’«»「」『』„‚‹›()（）\[\]{}]")
STOP = regex.compile(rf"\.{{2,}}|…+|[.{MARK}]+")
LABEL = regex.compile(r"\s*([^\s:：\d][^:：\d]{0,39}?)\s*[:：]\s*(\S.*)$")
OPENING, CLOSING = "“‘«「『„‚‹（([{", "”’»」』“‘›）)]}"
PAIRS = {"“": "”", "‘": "’", "«": "»", "「": "」", "『": "』", "„": "“”", "‚": "‘’", "‹": "›", "»": "«", "”": "”", "’": "’"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "{": "}"}
# The commonest function words, by which languages of one script are told apart for the statistics.
FUNCTION_WORDS = {
    "en": "the of and to in a is was for with at by on from not after", "fr": "le la les de des du et à est une un pour avec dans par au",
    "de": "der die das und den von zu mit im ist ein eine bei um auf nicht", "es": "el la los de del y en un una se con por para las que al",
}
LATIN = {*FUNCTION_WORDS, "Latin"}
LANGUAGE_OF = {w: [k for k, v in FUNCTION_WORDS.items() if w in v.split()] for w in " ".join(FUNCTION_WORDS.values()).split()}
NUMBERS = regex.compile(r"\d+")
VOWEL = regex.compile(r"[^\p{Latin}]|[aeiouyäöüáéíóúàèùâêîôûœ]")
OTHER_LETTERS = re.compile("[\u0370-\uffff]")
SCRIPTS = {
    "Greek": "\u0370-\u03ff", "Cyrillic": "\u0400-\u052f", "Hebrew": "\u0590-\u05ff", "Arabic": "\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufefe",
    "Devanagari": "\u0900-\u097f", "Thai": "\u0e00-\u0e7f", "Hiragana": "\u3041-\u30ff", "Hangul": "\uac00-\ud7a3", "Han": "\u3400-\u9fff",
}
SCRIPT_OF = [(n, re.compile(f"[{r}]")) for n, r in SCRIPTS.items()]


@lru_cache(maxsize=20_000)
def script(c: str) -> str:
    return next((n for n, r in SCRIPT_OF if r.match(c)), "")


@lru_cache(maxsize=1 << 16)
def statistics_language(line: str) -> str:
    """The script of a line, or for Latin letters the language whose function words it has most of."""
    votes: dict[str, int] = {}
    if not line.isascii() and (signs := OTHER_LETTERS.findall(line)):
        for c, n in Counter(signs).items():
            if g := script(c):
                votes[g] = votes.get(g, 0) + n
        best = max(votes, key=votes.get, default="")
        if best and votes[best] * 3 > len(line):
            return "Hiragana" if "Hiragana" in votes else best
    votes = {}
    for w in line.lower().split():
        for k in LANGUAGE_OF.get(w, ()):
            votes[k] = votes.get(k, 0) + 1
    return max(votes, key=votes.get) if votes else "Latin"


def lines_of(text: str) -> list[tuple[int, str]]:
    out, start = [], 0
    for line in text.split("\n"):
        out.append((start, line))
        start += len(line) + 1
    return out


def final(line: str) -> bool:
    """Whether a line ends with a final mark, closing signs aside."""
    return line.rstrip().rstrip("\"'”’“»«」』›)]}").endswith(ENDS)


def folded(line: str) -> str:
    return " ".join(line.casefold().rstrip(" \t\r:：").split())


@lru_cache(maxsize=200_000)
def kind(token: str) -> str:
    body = token.rstrip(".").casefold().replace("’", "'").rpartition("'")[2]
    return "0" if body[:1].isdigit() and not any(c.isalpha() for c in body) else body


def opening(line: str) -> str:
    """How a line begins: its first two words, or its first signs where words aren't parted."""
    words = line.split()[:2]
    return NUMBERS.sub("0", " ".join(w[:8] if len(w) > 14 else w for w in words).casefold())


def with_colon(line: str) -> str:
    return folded(line) + ":" if line.rstrip().endswith((":", "：")) else folded(line)


def beginnings(words: list[str], most: int = 6) -> Iterator[str]:
    """The first words of a line as ``with_colon`` has them: the first, the first two, and so on, but never all."""
    done = ""
    for n in range(1, min(most + 1, len(words))):
        w = words[n - 1].casefold()
        if bare := w.rstrip(":："):
            yield done + (bare if bare == w else bare + ":")
        else:
            yield with_colon(" ".join(words[:n]))
        done += w + " "


def count_text(text: str, counts: Counter, words_used: dict[str, Counter]) -> None:
    """Adds every event that the statistics count, as (language, what, a, b); the words themselves by language to ``words_used``."""
    before = ""
    for _, line in lines_of(text):
        last, before = before, line
        if not line.strip():
            continue
        lang = statistics_language(line)
        words = line.split()
        ended, item = final(line), ITEM.match(line)
        counts[lang, "lines", "", ""] += 1
        if not item:
            counts[lang, "resumes" if last.strip() and not final(last) else "opens", opening(line), ""] += 1
        if not ended and len(words) <= 7 and not item:
            counts[lang, "alone", folded(line), ""] += 1
        if ended or len(words) > 7:
            for x in beginnings(words):
                counts[lang, "begins", x, ""] += 1
        if m := LABEL.match(line):
            counts[lang, "label final" if ended else "label open", folded(m.group(1)), ""] += 1
        tokens = list(TOKEN.finditer(line))
        kinds = [kind(m.group()) for m in tokens]
        words_used.setdefault(lang, Counter()).update(kinds)
        for i, m in enumerate(tokens):
            end = m.end()
            if line[end - 1] != "." or line[end : end + 1] == ".":
                continue
            w = kinds[i]
            counts[lang, "period", w, ""] += 1
            rest = line[end:].lstrip(" \u00a0")[:1]
            if rest.islower() or rest.isdigit() or rest in ",;:،؛" and rest:
                counts[lang, "goes on", w, ""] += 1
            if i + 1 < len(tokens):
                counts[lang, "pair", w, kinds[i + 1]] += 1
            else:
                counts[lang, "ends", w, ""] += 1


def log_likelihood(a: float, b: float, ab: float, n: float) -> float:
    """Dunning's ratio for an event b that follows a more often than it would by chance."""

    def part(k: float, n: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (n - k) * math.log(1 - p)

    rest = max(n - a, 1)
    p, p1, p2 = b / n, ab / a, max(b - ab, 0) / rest
    return -2 * (part(ab, a, p) + part(max(b - ab, 0), rest, p) - part(ab, a, p1) - part(max(b - ab, 0), rest, p2))


class Statistics:
    """What is learned from all texts: sets by language."""

    def __init__(self, counts: dict[tuple[str, str, str, str], int]):
        self.abbreviations: dict[str, set[str]] = {}
        self.starters: dict[str, set[str]] = {}
        self.collocations: dict[str, set[tuple[str, str]]] = {}
        self.headings: set[tuple[str, str]] = set()
        self.labels: set[tuple[str, str]] = set()
        self.opens: set[tuple[str, str]] = set()
        self.sentence_labels: set[tuple[str, str]] = set()
        self.begins: set[tuple[str, str]] = set()
        self.all_abbreviations: set[str] = set()
        c = counts.get
        for lang in {k[0] for k in counts}:
            n = max(1, c((lang, "all token", "", ""), 0))
            periods = max(1, c((lang, "all period", "", ""), 0))
            own = [(what, a, b, k) for (g, what, a, b), k in counts.items() if g == lang]
            abbr = self.abbreviations_of(counts, lang)
            self.abbreviations[lang] = abbr
            self.all_abbreviations |= abbr
            if lang in LATIN:
                self.abbreviations.setdefault("any Latin", set()).update(abbr)
            # periods after abbreviations say nothing about what begins a sentence
            ends = max(1, periods - sum(c((lang, "period", w, ""), 0) for w in abbr))
            starts = {x: k for what, x, _, k in own if what == "start"}
            self.starters[lang] = {x for x, k in starts.items() if not x[:1].isdigit() and c((lang, "token", x, ""), 0) and k / ends > c((lang, "token", x, ""), k) / n and log_likelihood(ends, max(k, c((lang, "token", x, ""), k)), k, n) > 30}
            self.collocations[lang] = {
                (w, x) for what, w, x, k in own
                if what == "pair" and k > 1 and x not in self.starters[lang] and c((lang, "period", w, ""), 0) and k / max(1, c((lang, "token", w, ""), k)) > c((lang, "token", x, ""), k) / n
                and log_likelihood(max(k, c((lang, "token", w, ""), k)), max(k, c((lang, "token", x, ""), k)), k, n) > 7.88
            }
            for what, a, _, k in own:
                if what == "alone" and k >= 2 and k > 3 * c((lang, "begins", a, ""), 0):
                    self.headings.add((lang, a))
                if what == "label final" and k > c((lang, "label open", a, ""), 0):
                    self.sentence_labels.add((lang, a))
                if what == "label open" and k >= 2 and k > 4 * c((lang, "label final", a, ""), 0):
                    self.labels.add((lang, a))
                if what == "opens" and k >= 2 and k > (1 if lang in LATIN else 3) * c((lang, "resumes", a, ""), 0):
                    self.opens.add((lang, a))
                if what == "begins" and k > c((lang, "alone", a, ""), 0) and k >= 2:
                    self.begins.add((lang, a))

    @classmethod
    def abbreviations_of(cls, counts: dict[tuple[str, str, str, str], int], lang: str) -> set[str]:
        c = counts.get
        n, periods = (max(1, c((lang, f"all {what}", "", ""), 0)) for what in ("token", "period"))
        own = [(w, k) for (g, what, w, _), k in counts.items() if g == lang and what == "period" and w != "0"]
        return {w for w, k in own if cls._abbreviation(w, k, c((lang, "token", w, ""), k), c((lang, "ends", w, ""), 0), c((lang, "goes on", w, ""), 0), periods, n)}

    @staticmethod
    def _abbreviation(w: str, with_period: int, total: int, ends: int, goes_on: int, periods: int, n: int) -> bool:
        """Kiss and Strunk's score of a type that stands before a period.

        A word that always ends its sentence looks the same to it, so a longer type without inner periods must also be
        seen before a small letter, a digit or a comma, and hardly any may stand at the end of a line.
        """
        total = max(total, with_period)
        if "." not in w and len(w) > 3 and VOWEL.search(w) and goes_on * 4 < with_period or len(w) > 12 or ends * 10 > with_period:
            return False
        p, q = periods / n, 0.99
        without = total - with_period
        ll = -2 * ((with_period * math.log(p) + without * math.log(max(1e-12, 1 - p))) - (with_period * math.log(q) + without * math.log(1 - q)))
        length = max(1, sum(ch not in ".-" for ch in w))
        score = ll * math.exp(-length) * (w.count(".") + 1) * length ** -min(without, 60)
        return score >= 0.3


def learned(texts: DataFrame, text: str = "text", share: float = 5e-6) -> Statistics:
    """Counted over all ``texts``. Only what makes up at least ``share`` of its language's lines or tokens, and occurs twice, comes to the
    driver: at most ``1 / share`` entries of each kind and language. What follows a period is summed over all words but abbreviations before that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            used: dict[str, Counter] = {}
            for t in b["t"]:
                count_text(t, c, used)
            rows = [(*k, n) for k, n in c.items()] + [(lang, "token", w, "", n) for lang, words in used.items() for w, n in words.items()]
            yield pd.DataFrame(rows, columns=["lang", "what", "a", "b", "n"])

    src = spread(texts.select(F.col(text).alias("t")).where("t is not null and t != ''"))
    c = src.mapInPandas(run, "lang string, what string, a string, b string, n bigint").groupBy("lang", "what", "a", "b").agg(F.sum("n").alias("n"))
    c = cut(c)
    total = {(r.lang, r.what): r.n for r in c.where("what in ('token', 'period', 'lines')").groupBy("lang", "what").agg(F.sum("n").alias("n")).collect()}  # a few languages
    least = F.create_map(*[F.lit(x) for (lang, what), n in total.items() if what != "period" for x in (f"{lang}|{'t' if what == 'token' else 'l'}", share * n)] or [F.lit(""), F.lit(0.0)])
    of = F.when(F.col("what").isin("token", "period", "pair", "ends", "goes on", "start"), "t").otherwise("l")
    frequent = (F.col("n") >= 2) & (F.col("n") >= least[F.concat_ws("|", F.col("lang"), of)])
    counts = {(r.lang, r.what, r.a, r.b): r.n for r in c.where(frequent).collect()}
    counts |= {(lang, f"all {what}", "", ""): n for (lang, what), n in total.items()}
    short = texts.sparkSession.createDataFrame([(lang, w) for lang in sorted({k[0] for k in counts}) for w in sorted(Statistics.abbreviations_of(counts, lang))], "lang string, a string")
    starts = c.where("what = 'pair'").join(F.broadcast(short), ["lang", "a"], "left_anti").groupBy("lang", F.col("b").alias("a")).agg(F.sum("n").alias("n")).withColumn("what", F.lit("start"))
    counts |= {(r.lang, "start", r.a, ""): r.n for r in starts.where(frequent).collect()}
    return Statistics(counts)


def next_start(text: str, i: int, end: int) -> str:
    """The first letter or digit at or after ``i``, past blanks, quotes and opening signs; '' if another sign comes first."""
    while i < end and (text[i].isspace() or text[i] in "\"'“‘«„‚‹「『([¿¡-–—•*\u200b\u200e\u200f\ufeff\u2060"):
        i += 1
    return text[i] if i < end else ""


def blocks(text: str, s: Statistics) -> Iterator[tuple[int, int, bool, str]]:
    """(start, end, whole, language): stretches of lines; ``whole`` if it is one unit as it is."""
    open_at, open_end, open_lang = -1, -1, ""
    lines = lines_of(text)

    def flush() -> Iterator[tuple[int, int, bool, str]]:
        nonlocal open_at
        if open_at >= 0:
            yield open_at, open_end, False, statistics_language(text[open_at:open_end])
        open_at = -1

    item_open = -1
    for k, (start, line) in enumerate(lines):
        end = start + len(line)
        if not line.strip():
            if item_open >= 0:
                yield item_open, open_end, True, open_lang
                item_open = -1
            yield from flush()
            continue
        lang = statistics_language(line)
        following = lines[k + 1][1] if k + 1 < len(lines) else ""
        first = line.lstrip()[0]
        if ITEM.match(line):
            if item_open >= 0:
                yield item_open, open_end, True, open_lang
            yield from flush()
            item_open, open_end, open_lang = start, end, lang
            continue
        if item_open >= 0:
            if first.islower() and not final(text[item_open:open_end]):  # the item goes on
                open_end = end
                continue
            yield item_open, open_end, True, open_lang
            item_open = -1
        goes_on = open_at >= 0 and not final(text[open_at:open_end])
        if goes_on and _starts_anew(text[open_at:open_end], line, lang, s):  # the mark before is missing
            yield from flush()
            goes_on = False
        if not (goes_on and first.islower()) and _alone(line, following, goes_on, lang, s):
            yield from flush()
            yield start, end, True, lang
            continue
        if open_at < 0:
            open_at = start
        open_end = end
    if item_open >= 0:
        yield item_open, open_end, True, open_lang
    yield from flush()


def _starts_anew(unfinished: str, line: str, lang: str, s: Statistics) -> bool:
    """Whether a line begins a sentence although the one before it has no final mark."""
    last = statistics_language(unfinished.rstrip().rpartition("\n")[2])
    if lang != last and not {lang, last} <= LATIN:
        return True
    if line.lstrip()[0].islower() or line.lstrip()[0].isdigit():
        return False
    return any((g, opening(line)) in s.opens for g in (LATIN if lang in LATIN else (lang,)))


def _alone(line: str, following: str, goes_on: bool, lang: str, s: Statistics) -> bool:
    """Whether a line is a heading or a label with its value."""
    if final(line):
        return False
    key = folded(line)
    words = line.split()
    nxt = following.lstrip()[:1]
    if (lang, key) in s.headings and not nxt.islower():
        return True
    digits = any(c.isdigit() for c in line)
    if line.rstrip().endswith((":", "：")):
        return len(words) <= 6 and not digits and not goes_on and (lang, key + ":") not in s.begins
    m = LABEL.match(line)
    if m and (not goes_on or (lang, folded(m.group(1))) in s.labels):
        value = m.group(2).split()
        return len(m.group(1).split()) <= 4 and len(value) <= 5 and (lang, folded(m.group(1))) not in s.sentence_labels and not nxt.islower()
    if digits or len(words) > 4 or len(line) > 60 or goes_on:
        return False
    if (lang, key) in s.begins or len(words) > 1 and (lang, folded(" ".join(words[:2]))) in s.begins:
        return False
    if line.lstrip()[0].islower() or nxt.islower() or nxt.isdigit() or not nxt:
        return not nxt and not line.lstrip()[0].islower()
    return True


def enclosed(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """(opening, closing, is quotation) of matched quotations and brackets, outermost first."""
    out, stack = [], []
    for m in ENCLOSING.finditer(text, start, end):
        i, c = m.start(), m.group()
        before = text[i - 1] if i > start else " "
        after = text[i + 1] if i + 1 < end else " "
        if c in "'’‘" and before.isalnum() and after.isalnum():
            continue
        match = next((d for d in range(len(stack) - 1, -1, -1) if c in stack[d][1] and i > stack[d][0]), None)
        if c in "\"'":
            if match is not None and not (before.isspace() and after.isalnum()):
                pass
            elif after.isspace() or c == "'" and before.isalnum():
                continue
            else:
                match = None
        if match is not None:
            if c in "’'" and before.isalnum() and before in "sS" and after.isspace() and regex.search(rf"^[^\n]{{0,80}}[.,!?…]{c}", text[i + 1 : end]):
                continue  # a possessive inside a quotation that closes later
            out.append((stack[match][0], i, stack[match][2]))
            del stack[match:]
        elif c in BRACKETS:
            stack.append((i, BRACKETS[c], False))
        elif c in PAIRS and c not in "”’»":
            stack.append((i, PAIRS[c], True))
        elif c in "\"'":
            stack.append((i, c, True))
        elif c == "»" or c == "”" and (before.isspace() or before in ":："):
            stack.append((i, PAIRS[c], True))
    return sorted(out)


def split_block(text: str, start: int, end: int, lang: str, s: Statistics) -> Iterator[tuple[int, int]]:
    """The sentences of a block, blanks at their ends included."""
    starters, collocations = s.starters.get(lang, ()), s.collocations.get(lang, ())
    known = lambda g: s.abbreviations.get("any Latin" if g == "Latin" else g, ())
    spans = enclosed(text, start, end)
    at = start
    i = start
    while m := STOP.search(text, i, end):
        mark, i = m.group(), m.end()
        while i < end and text[i] in "\"'”’»」』“‘›）)]}" and any(b == i for _, b, _ in spans):
            i += 1
        j = i
        if text[j : j + 2].isspace() is False and lang == "fr" and text[j : j + 2].strip() in ("»", "”") and any(b == j + 1 for _, b, _ in spans):
            j = i = j + 2  # a blank before the closing sign
        inside = [x for x in spans if x[0] < m.start() and x[1] >= i]
        if inside:
            continue
        closed = [x for x in spans if m.end() <= x[1] < i or m.start() < x[1] < i]
        nxt = next_start(text, i, end)
        gap = i < end and text[i].isspace()
        if not text[i:end].strip():
            break
        if text[i : end].lstrip()[:1] in ",;:，、；：،؛" or nxt.islower():
            continue
        quoted = any(q for *_, q in closed)
        cased = nxt.isupper()
        if quoted and not cased:
            if not (nxt.isdigit() and gap and closed[0][0] == at + len(text[at:]) - len(text[at:].lstrip())):
                continue
        if mark[0] in "…" or len(mark) > 1 and set(mark) == {"."}:
            if not cased:
                continue
        elif mark == ".":
            if not gap and not closed:
                if not (nxt and UNSPACED.match(nxt)):
                    continue
            if not closed:
                t = None
                for t in TOKEN.finditer(text, max(at, m.start() - 60), m.end()):
                    pass
                if t is not None and t.end() == m.end():
                    w = kind(t.group())
                    if w not in s.all_abbreviations and not (len(w) <= 4 and w.isalpha()):  # no way for it to be one
                        yield at, i
                        at = i
                        continue
                    nt = TOKEN.search(text, i, end)
                    x = kind(nt.group()) if nt else ""
                    initial = len(w) == 1 and w.isalpha()
                    here = lambda: statistics_language(text[text.rfind("\n", start, m.start()) + 1 : m.end() + 40])  # noqa: E731, B023
                    if initial and cased or w in known(lang) or w in s.all_abbreviations and w in known(here()):
                        if not (cased and x in starters and (w, x) not in collocations):
                            continue
                    elif x == "0" and len(w) <= 4 and w.isalpha() and lang in LATIN and any((w, x) in s.collocations.get(g, ()) for g in (lang, here())):
                        continue
        elif not gap and not closed and mark in "!?" and nxt.isalnum() and not UNSPACED.match(nxt):
            continue
        yield at, i
        at = i
    yield at, end


UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
THAI = regex.compile(r"(?<=[\p{Thai}\p{N}\])»”\"])\s+(?=[\p{Thai}\[(«“\"])")


def thai(text: str, start: int, end: int, least: int = 10) -> Iterator[tuple[int, int]]:
    """Thai writes no mark at the end of a sentence but a blank; blanks next to a short stretch are inside one."""
    spans = enclosed(text, start, end)
    at = start
    for m in THAI.finditer(text, start, end):
        nxt = THAI.search(text, m.end(), end)
        if m.start() - at < least or (nxt.start() if nxt else end) - m.end() < least or any(a < m.start() <= b for a, b, _ in spans):
            continue
        yield at, m.end()
        at = m.end()
    yield at, end


def units(text: str | None, s: Statistics) -> list[tuple[int, int]]:
    """(start, end) of every unit of a text."""
    out = []
    for start, end, whole, lang in blocks(text or "", s):
        if whole:
            parts = [(start, end)]
        else:
            parts = [p for a, b in split_block(text, start, end, lang, s) for p in (thai(text, a, b) if lang == "Thai" else [(a, b)])]
        for a, b in parts:
            t = text[a:b]
            left = len(t) - len(t.lstrip())
            if t.strip():
                out.append((a + left, a + len(t.rstrip())))
    return out


def sentence_units(df: DataFrame, key: str, text: str = "text", at: str | None = None, statistics: Statistics | None = None) -> DataFrame:
    """(key, start_pos, end_pos): the units of every text, offsets in code points.

    ``at``, if given, names a column with the offset of each sign, and of the end, in another form of the text; the
    units come out with those offsets. Null, empty and blank texts have no units. Rows with equal key and text count once.
    """
    stats = statistics or learned(df, text)
    has = F.col(at) if at else F.lit(None).cast("array<int>")
    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"), has.alias("at")).where("k is not null and t is not null").dropDuplicates(["k", "t"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, m in b.itertuples(index=False, name=None):
                for x, y in units(t, stats):
                    rows.append((k, x, y) if m is None else (k, int(m[x]), int(m[y])))
            yield pd.DataFrame(rows, columns=[key, "start_pos", "end_pos"])

    return src.mapInPandas(run, f"{key} {dict(src.dtypes)['k']}, start_pos int, end_pos int")


def texts_of_units(df: DataFrame, key: str, text: str = "text", at: str | None = None, statistics: Statistics | None = None) -> DataFrame:
    """(key, units): the units of every text in order, each with its offsets as in ``sentence_units`` and its text."""
    stats = statistics or learned(df, text)
    has = F.col(at) if at else F.lit(None).cast("array<int>")
    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"), has.alias("at")).where("k is not null and t is not null").dropDuplicates(["k", "t"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, [{"start_pos": x if m is None else int(m[x]), "end_pos": y if m is None else int(m[y]), "text": t[x:y]} for x, y in units(t, stats)]) for k, t, m in b.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[key, "units"])

    return src.mapInPandas(run, f"{key} {dict(src.dtypes)['k']}, units array<struct<start_pos:int,end_pos:int,text:string>>")
