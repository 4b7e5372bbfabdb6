"""Personal information in free text, found by weak supervision and replaced by typed placeholders (problem 6).

Wide patterns propose candidates. Labelers - patterns, word lists learned from the texts themselves, and context words - vote
for a type or against it, or abstain. Expectation-maximisation over the votes of all candidates estimates how reliable each
labeler is and what each pattern of votes means; a span classifier is trained on that and decides every candidate.
Texts are read in their same-looking form, so that disguised values count, with offsets as stored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.lookalike import character_table
from wardloom.session import cut, may_contain, spread

TYPES = ("NONE", "EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
NONE, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)
ABSTAIN = -1

# Words that stand before a value or a name and say what it is, in the languages of the texts.
PHONE_WORDS = "tel|tél|phone|telephone|teléfono|telefono|telefon|téléphone|mobile|móvil|handy|fax|call|called|appeler|rappellera|texted|reached|unter|contact|al|الهاتف|هاتف|الرقم|للتواصل|جوال"
ID_WORDS = "mrn|id|civil|passport|file|card|insurance|record|dossier|expediente|documento|akten-nr|akte|akten|ausweis|versicherung|passeport|pasaporte|carte|cédula|nss|dni|المدني|الملف|الجواز|التأمين|ملف|هوية"
OTHER_WORDS = "accession|order|serial|lot|lote|batch|firmware|checksum|chk|ref|study|series|serie|série|film|charge|chargen-nr|gerät|analyser|estudio|étude|document|request|slice|specimen|sample|atlas|review|dose|bench|grid|ext|intern|interne|muestra|präparat|prélèvement|dispositivo|appareil|aparato|numéro|الطلب|الجهاز|والدفعة|الدراسة|للمراجعة|العينة|الشريحة"
HOME_WORDS = "address|home|lives|live|posted|domicile|domicilio|habite|wohnhaft|anschrift|adresse|vive|dirección|العنوان|يسكن|ويسكن|يقيم|of|kin|at|to|in|en"
TITLES = "dr|dra|prof|mr|mrs|ms|miss|pt|sr|sra|srta|don|doña|mme|mlle|m|frau|herr|sir|nurse|المريض|المريضة|د|الدكتور|الدكتورة|السيد|السيدة|الأب|الأم|ابنته|ابنه|باسم|مع"
NAME_WORDS = "name|names|patient|patient=|nom|nombre|paciente|physician|pathologist|radiologist|surgeon|consultant|nurse|present|daughter|son|brother|sister|mother|father|wife|husband|kin|tochter|sohn|bruder|schwester|mutter|vater|ehefrau|ehemann|familiar|hijo|hija|hermano|hermana|madre|padre|esposa|esposo|fils|fille|frère|sœur|mère|père|copy|to|me|with|belongs|by|von|par|por|le|patientin|اسم|الأشعة"
EPONYM_AFTER = "sign|disease|study|reflex|scale|test|syndrome|score|procedure|maneuver|manoeuvre|catheter|criteria|classification|grid|gland|line|point|team|ward|unit|clinic|hospital|house|quarter|reflexe"
STREETS = "street|road|lane|avenue|drive|close|way|court|place|square|terrace|hill|crescent|gardens|row|mews|boulevard|parade|grove"

def _sets(words: str) -> frozenset[str]:
    return frozenset(words.split("|"))


PHONE_SET, ID_SET, OTHER_SET, HOME_SET, TITLE_SET, NAME_SET = map(_sets, (PHONE_WORDS, ID_WORDS, OTHER_WORDS, HOME_WORDS, TITLES, NAME_WORDS))

EMAIL_AT = re.compile(r"(?i)(?<![\w.+-])[a-z0-9][\w.+-]*(?:@|\s?[\[({]\s?at\s?[\])}]\s?)[a-z0-9-]+(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[a-z0-9-]+)+", re.ASCII)
EMAIL_WORDS = re.compile(r"(?i)(?<![\w.+-])[a-z0-9][\w.+-]*\s+at\s+[a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)+", re.ASCII)
NUMBER = re.compile(r"(?<![\w+])(?:\+|00)?(?:\(\d{2,4}\)[ ]?)?\d(?:[ .\-/‑–]{0,2}\d){6,14}(?![\w])")
CODE = re.compile(r"(?<![\w-])[A-Z]{1,5}(?:-\d{1,4}){0,2}-?\d{4,12}(?![\w])")
DATE = re.compile(r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d{4}[/.-]\d{1,2}[/.-]\d{1,2}")
_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿœ"
_WORD = rf"[{_UP}][{_LOW}{_UP}'’-]*[{_LOW}{_UP}]"
ADDRESSES = [
    re.compile(rf"(?i:P\.? ?O\.? ?Box|Postfach|Apartado|Apdo\.|B\.P\.) ?\d+(?:, ?(?:\d{{4,5}} )?{_WORD}(?: {_WORD}){{0,2}})?"),
    re.compile(rf"(?:(?i:Flat|Apt\.?|Unit|Suite) \d+\w?, ?)?\d+[A-Za-z]?,? (?:{_WORD} ){{1,4}}(?i:{STREETS})\b(?:, ?(?:\d{{4,5}} )?{_WORD}(?: {_WORD}){{0,2}})?"),
    re.compile(rf"(?i:Block) \d+\w?, ?(?i:Street) \d+\w?, ?(?i:House) \d+\w?(?:, ?{_WORD}(?: {_WORD}){{0,2}})?"),
    re.compile(rf"\d+(?: bis| ter| quater)?,? (?i:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours|route) [^,\n\d]{{2,50}}(?:, ?(?:\d{{4,5}} )?{_WORD}(?:[ -]{_WORD}){{0,2}})?"),
    re.compile(rf"(?:{_WORD}(?:straße|strasse|weg|gasse|platz|allee|ring|damm)|(?:{_WORD} ){{0,2}}(?:Straße|Weg|Gasse|Platz|Allee|Ring|Damm)|(?:Am|An der|Im|Zum|Zur|Auf dem|Unter den) {_WORD}) \d+\w?(?:, ?(?:\d{{4,5}} )?{_WORD}(?: {_WORD}){{0,2}})?"),
    re.compile(rf"(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Camino|Carretera|Ronda|Travesía) [^,\n\d]{{2,50}},? ?\d+(?:, ?\d+\.?[ºª°o]? ?[A-Z]?(?![a-z]))?(?:, ?(?:\d{{4,5}} )?{_WORD}(?: {_WORD}){{0,2}})?"),
    re.compile(r"قطعة \d+،? شارع \d+،? منزل \d+(?:، ?[ء-ي]+(?: [ء-ي]+){0,2}(?=[.\n،]|$))?"),
    re.compile(r"شارع [ء-ي]+(?: [ء-ي]+){0,2} \d+(?:، ?[ء-ي]+(?: [ء-ي]+){0,3})?"),
    re.compile(r"(?:ص\.? ?ب\.?|صندوق بريد) ?\d+(?:، ?[ء-ي]+(?: [ء-ي]+){0,2})?"),
]
#: What stands in every match of the pattern of the same place: one of the signs as written, or in small letters, and a part of it.
ADDRESS_SIGNS = [
    ((), ("box", "postfach", "apartado", "apdo", "b.p."), None), ((), tuple(f" {x}" for x in STREETS.split("|")), re.compile(rf"\d[A-Za-z]?,? [{_UP}]")), ((), ("block",), None),
    ((), tuple(f" {x} " for x in "rue avenue boulevard place chemin impasse quai allée cours route".split()), None),
    ((), (), re.compile(rf"(?:[sS]traße|[sS]trasse|[wW]eg|[gG]asse|[pP]latz|[aA]llee|[rR]ing|[dD]amm) \d|(?:Am|An der|Im|Zum|Zur|Auf dem|Unter den) [{_UP}]\S* \d")),
    (("Calle", "C/", "Avda", "Avenida", "Plaza", "Paseo", "Camino", "Carretera", "Ronda", "Travesía"), (), None), (("قطعة",), (), None), (("شارع",), (), None), (("ص", "صندوق"), (), None),
]


#: By one automaton over texts in small letters: what some sign of every pattern of addresses can stand in; it lets through whatever ``ADDRESS_SIGNS`` do, unless no match follows.
ADDRESS_LIKELY = "|".join([
    r"box|postfach|apartado|apdo|b\.p\.|block|calle|c/|avda|avenida|plaza|paseo|camino|carretera|ronda|travesía|قطعة|شارع|ص\.? ?ب|صندوق", f" (?:{STREETS})", " (?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours|route) ",
    r"(?:straße|strasse|weg|gasse|platz|allee|ring|damm) \pN|(?:am|an der|im|zum|zur|auf dem|unter den) \S+ \pN",
])


def likely_address(lows: list[str]) -> list[bool]:
    return pc.match_substring_regex(pa.array([x.encode("utf-8", "replace") for x in lows], "binary").cast("string"), ADDRESS_LIKELY).to_pylist()


def address_lines(texts: list[str], lows: list[str]) -> list[list[tuple[int, int]]]:
    """(start, end) of the lines of each of several texts, also given in small letters, that may hold an address. No address goes over a line's end."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    owners, places, lines = [], [], []
    for i, (t, low, likely) in enumerate(zip(texts, lows, likely_address(lows))):
        start = 0
        for line, small in zip(t.split("\n"), low.split("\n")) if likely else ():
            owners.append(i)
            places.append((start, start + len(line)))
            lines.append(small)
            start += len(line) + 1
    for i, x, likely in zip(owners, places, likely_address(lines)):
        if likely:
            out[i].append(x)
    return out


def starts(first: re.Pattern, whole: re.Pattern, text: str) -> Iterator[re.Match]:
    """As ``whole.finditer``, tried only where ``first`` matches: it does wherever a match of ``whole`` begins, and begins with a plain set of signs, which is fast to look for."""
    at = 0
    while m := first.search(text, at):
        at = m.start() + 1
        if x := whole.match(text, m.start()):
            yield x
            at = max(at, x.end())


CODE_START = re.compile(r"[A-Z][A-Z]{0,4}-?\d")
NUMBER_START = re.compile(r"[+(\d][\d() .\-/‑–]{6}")


def address_matches(text: str, lines: list[tuple[int, int]]) -> Iterator[re.Match]:
    parts = [(a, b, x := text[a:b], x.lower()) for a, b in lines]
    for r, (written, small, part) in zip(ADDRESSES, ADDRESS_SIGNS) if parts else ():
        for a, b, x, low in parts:
            if (not written or any(w in x for w in written)) and (not small or any(w in low for w in small)) and (part is None or part.search(x)):
                yield from r.finditer(text, a, b)


PARTICLE = r"(?:bin|ibn|bint|van der|van|von|de la|del|de|da|di|el|al)"
PART = rf"(?:[{_UP}]\.(?!\w)|[{_UP}][{_LOW}]+(?:[-'’][{_UP}][{_LOW}]+)*|[{_UP}]{{2,}}(?:-[{_UP}]{{2,}})*)"
#: As PART after no sign of a word; the look behind stands after the first letter, so that the pattern begins with a plain set of signs.
FIRST_PART = rf"[{_UP}](?<![\w@.+-].)(?:\.(?!\w)|[{_LOW}]+(?:[-'’][{_UP}][{_LOW}]+)*|[{_UP}]+(?:-[{_UP}]{{2,}})*)"
NAMES = re.compile(rf"{FIRST_PART}(?:(?: (?:{PARTICLE}|{PARTICLE.upper()}))? {PART}){{0,4}}(?:, {PART}(?:(?: {PARTICLE})? {PART}){{0,2}})?")
_ARABIC_TITLES = [w for w in (TITLES + "|اسم المريض|اسم المريضة|طبيب الأشعة|الطبيب").split("|") if w[0] > "ÿ"]
_BY_LETTER = "|".join(f"{c}(?<![ء-ي].)(?:{'|'.join(w[1:] for w in _ARABIC_TITLES if w[0] == c)})" for c in dict.fromkeys(w[0] for w in _ARABIC_TITLES))
ARABIC_BEFORE = re.compile(rf"(?:{_BY_LETTER})[.:]?\s+(?:د\. ?)?(?=((?:[ء-ي]+ ){{0,4}}[ء-ي]+))")
ARABIC = re.compile("[ء-ي]")
STRONG = re.compile(rf"(?:Patient Name|Name|Nombre|Nom du patient|Paciente|Patient|Reporting Physician|Consultant Pathologist)\s*[:=]\s*(?:\n\s*)?(?:Dr\.? )?({PART}(?:(?:,? (?:{PARTICLE}))?,? {PART}){{0,4}})|(?:\b(?:Dr|Mr|Mrs|Ms|Sra?|Prof|Dra)\.? |\b(?:Frau|Herr|Mme|Mlle) )({PART}(?:(?: {PARTICLE})? {PART}){{0,3}})|(?:اسم المريضة?|طبيب الأشعة):? (?:د\. )?([ء-ي]+(?: [ء-ي]+){{1,4}})(?=\n|$)")
#: What every match of STRONG begins with.
STRONG_START = re.compile("Patient|Name|Nom|Paciente|Reporting|Consultant|Dr|Mr|Ms|Sr|Prof|Frau|Herr|Mme|Mlle|اسم|طبيب")
ARABIC_PARTICLES = {"بن", "بنت", "ابن", "أبو", "أم", "آل"}
FIRST_WORD = re.compile(rf"[{_UP}][{_LOW}]+(?= [{_LOW}])")
EDGES = ".,;:!?()[]{}<>\"'“”‘’«»،؛؟…-–—/|="
WORD = re.compile(r"[^\W_][\w.'’=-]*")
ODD = frozenset(c for c in character_table() if c != " " and not "؀" <= c <= "ݿ" and unicodedata.normalize("NFC", character_table()[c]) != c) | frozenset(map(chr, range(0x300, 0x370)))

MARKS = "\u0300", "\u036f"
def sign_of(signs: frozenset[str]) -> re.Pattern:
    """One of many signs. Those beyond the first plane count as one range, since a set with them isn't looked up in a table."""
    return re.compile("[" + re.escape("".join(sorted(c for c in signs if c <= "\uffff"))) + "\U00010000-\U0010ffff]")


ODD_SIGN = sign_of(ODD)
FOLDED = {ord(c): unicodedata.normalize("NFC", character_table()[c]) for c in ODD if c in character_table() and not ("\u0600" <= c <= "\u06ff")}
#: Signs that don't fold to exactly one.
RESIZING = frozenset(c for c in ODD if len(FOLDED.get(ord(c), c)) != 1 or MARKS[0] <= c <= MARKS[1])
RESIZING_SIGN = sign_of(RESIZING)


def _one(m: re.Match) -> str:
    return FOLDED.get(ord(m.group()), m.group())


def first_words(text: str) -> Iterator[str]:
    """The capitalised first words of sentences and lines that go on in small letters."""
    for m in FIRST_WORD.finditer(text):
        i = m.start()
        if i and not text[i - 1].isspace():
            continue
        before = text[max(0, i - 80) : i]
        rest = before.rstrip()
        if not rest and i > 80:
            rest = (before := text[:i]).rstrip()
        blank = before[len(rest) :]
        if not rest or "\n" in blank or blank[0] == " " and rest[-1] in ".!?":
            yield m.group()


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alikes, invisible signs and combining accents made plain, and the stored offset of each of its signs; none if nothing changed."""
    if text.isascii() or not ODD_SIGN.search(text) or ODD.isdisjoint(text):
        return text, None
    if not RESIZING_SIGN.search(text) or RESIZING.isdisjoint(text):
        return ODD_SIGN.sub(_one, text), None  # sign for sign, so that offsets stay
    out: list[str] = []
    at: list[int] = []
    table = character_table()
    done = 0
    for m in ODD_SIGN.finditer(text):
        i, c = m.start(), m.group()
        if c > "\uffff" and c not in ODD:
            continue
        if i > done:
            out.append(text[done:i])
            at += range(done, i)
        done = i + 1
        if MARKS[0] <= c <= MARKS[1] and out:
            last = out[-1]
            both = unicodedata.normalize("NFC", last[-1:] + c)
            if last and len(both) == 1:
                out[-1] = last[:-1] + both
                continue
        t = unicodedata.normalize("NFC", table[c]) if c in table and not ("\u0600" <= c <= "\u06ff") else c
        if t:
            out.append(t)
            at += [i] * len(t)
    out.append(text[done:])
    at += range(done, len(text))
    return "".join(out), at


class Both:
    """Two sets as one."""

    def __init__(self, first: set[str], second: set[str]):
        self.first, self.second = first, second

    def __contains__(self, w: str) -> bool:
        return w in self.first or w in self.second


class Lists:
    """Word lists learned from all texts."""

    def __init__(self, names: set[str] | Both, common: set[str] | Both):
        self.names, self.common = names, common

    def missing(self, words: set[str]) -> list[str]:
        return [w for w in words if w not in self.names and w not in self.common]


def learned_lists(texts: DataFrame, text: str = "text", share: float = 2e-6) -> tuple[Lists, DataFrame]:
    """Words of names in places that always hold names, and words in common use in small letters, each seen twice at least.

    The words that make up at least ``share`` of all come to the driver, hence at most ``1 / share``; the rest stays a table
    (w, name), where ``name`` is false for common words.
    """

    def plain(c: Counter) -> pd.DataFrame:
        """Tokens as words: only those all in small letters, or in letters that have no case, count as used."""
        out: Counter = Counter()
        for w, n in c.items():
            if w[0] in "\x01\x02":
                out[w] += n
            elif (v := w.strip(EDGES)).isalpha() and len(v) > 1 and v == v.lower():
                out[v] += n
        c.clear()
        return pd.DataFrame(list(out.items()), columns=["w", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b["t"]:
                t, _ = fold(t)
                c.update(t.split())
                c.update(["\x02" + w.lower() for w in first_words(t)])
                if " dot " in t:
                    for m in EMAIL_WORDS.finditer(t):  # the name in an address is no use of a word
                        c[m.group().split()[0]] -= 1
                for m in starts(STRONG_START, STRONG, t):
                    for w in re.split(r"[\s,]+", next(g for g in m.groups() if g)):
                        if len(w.strip(".")) > 1 and w.lower() not in ("bin", "de", "al") and w.lower().rstrip(".") not in TITLE_SET | NAME_SET and w not in ARABIC_PARTICLES:
                            c["\x01" + w.casefold()] += 1
            if len(c) > 200_000:
                yield plain(c)
        yield plain(c)

    src = spread(texts.select(F.col(text).alias("t")).where("t is not null"))
    counted = cut(src.mapInPandas(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    named = F.substring("w", 1, 1) == "\x01"
    split = counted.where("n >= 2").select(F.when(F.substring("w", 1, 1).isin("\x01", "\x02"), F.expr("substring(w, 2)")).otherwise(F.col("w")).alias("w"), F.when(named, F.col("n")).otherwise(0).alias("names"), F.when(named, 0).otherwise(F.col("n")).alias("used"))
    # a word used so much more often than in names is no name; Arabic has no small letters, so all its words count as used
    often = F.when(F.substring("w", 1, 1) < "\u0600", 3).otherwise(8)
    judged = split.groupBy("w").agg(F.sum("names").alias("names"), F.sum("used").alias("used")).select("w", (F.col("used") < often * F.col("names")).alias("name"), (F.greatest("names", "used") >= share * total).alias("often"))
    told = judged.where("often").select("w", "name").collect()
    return Lists({r.w for r in told if r.name}, {r.w for r in told if not r.name}), judged.where("not often").select("w", "name")


INITIAL = re.compile(rf"[{_UP}]\.")
TITLE_OR_NAME = TITLE_SET | NAME_SET
EPONYM = re.compile(rf"(?:['’]s)? (?:{EPONYM_AFTER})\b", re.I)
GROUPED = re.compile(r"\(\d{3}\) ?\d{3}-\d{4}|\d\d(?: \d\d){4}|\d{4}[. ]\d{4}|0\d{2,4}/\d{5,9}")


def words_before(text: str, start: int, n: int = 4) -> list[str]:
    before = text[max(0, start - 40) : start]
    found = WORD.findall(" ".join(before.split()[-n:]))  # no word has a blank inside
    if len(found) < n:
        found = WORD.findall(before)
    return [w.lower().rstrip(".:=") for w in found[-n:]]


def number_votes(text: str, s: int, e: int) -> list[int]:
    v = text[s:e]
    digits = [c for c in v if c.isdigit()]
    before = words_before(text, s)
    near = next((t for w in reversed(before) for words, t in ((OTHER_SET, NONE), (PHONE_SET, PHONE), (ID_SET, ID)) if w in words), ABSTAIN)
    last = before[-1] if before else ""
    return [
        PHONE if v[0] == "+" or v[:2] == "00" and len(digits) > 10 else ABSTAIN,
        PHONE if GROUPED.fullmatch(v) else ABSTAIN,
        ID if len(digits) == 12 and v[0] not in "+(" else ABSTAIN,
        (ID if re.match(r"(?:MRN|INS)-|[NPX]\d{7}$", v) else NONE) if v[0].isalpha() and v[0] < "؀" else ABSTAIN,
        near,
        NONE if last in OTHER_SET or DATE.fullmatch(v) else ABSTAIN,
        NONE if text[max(0, s - 1) : s] in ("-", "/", ".", ",") or len(digits) < 7 and not v[0].isalpha() else ABSTAIN,
        PHONE if last in PHONE_SET else ID if last in ID_SET else ABSTAIN,
    ]


def name_votes(text: str, s: int, e: int, lists: Lists) -> list[int]:
    parts = [w.strip(".,").casefold() for w in re.split(r"[\s,]+", text[s:e])]
    parts = [w for w in parts if len(w) > 1 and w not in ("bin", "ibn", "de", "del", "von", "van")]
    known = sum(w in lists.names or any(x in lists.names for x in w.split("-")) for w in parts)
    common = sum(w in lists.common for w in parts)
    before = words_before(text, s, 2)
    last = before[-1] if before else ""
    lead = text[max(0, s - 3) : s]
    return [
        NAME if parts and known == len(parts) else ABSTAIN if known else NONE,
        NAME if known and not common else ABSTAIN,
        NONE if common and not known else ABSTAIN,
        NAME if last in TITLE_SET and re.search(r"[\s.:]$", lead) else ABSTAIN,
        NAME if last in NAME_SET and (text[s - 2 : s - 1] in ":=-," or "=" in lead or known) else ABSTAIN,
        NONE if EPONYM.match(text, e) or last in ("st", "saint", "são") or not parts else ABSTAIN,
        NONE if len(parts) == 1 and last in ("from", "in", "near", "aus", "de", "à", "en", "um", "von") and not re.search(r"[.:]\s?$", lead) else ABSTAIN,
        NONE if re.match(r"[:=]|\s*\d", text[e : e + 2]) and known < len(parts) else ABSTAIN,
        NAME if re.search(r"(?:^|\s)\w\.(?:\s|$)", text[s:e]) and not common else ABSTAIN,
    ]


@lru_cache(1 << 16)
def forms(w: str) -> frozenset[str]:
    """The forms in which a word of a run of capitalised words is looked up."""
    a = w.strip(".,").casefold()
    b = a[:-2] if a.endswith(("'s", "’s")) else a
    return frozenset(x for x in (a, b, w.casefold().rstrip("."), *a.split("-"), *b.split("-")) if len(x) > 1)


def candidates(text: str, lists: Lists, asked: set[str], low: str | None = None, lines: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, list[int]]]:
    """(start, end, type proposed, votes) of everything that may be personal; the words that the lists may be asked for are added to ``asked``.

    ``low`` is the text in small letters, ``lines`` are those that may hold an address, if these are known.
    """
    out = []
    taken: list[tuple[int, int]] = []
    low = text.lower() if low is None else low
    for r, sure, signs in ((EMAIL_AT, True, ("@", "at]", "at ]", "at)", "at )", "at}")), (EMAIL_WORDS, False, (" dot ",))):
        if any(x in low for x in signs):
            for m in r.finditer(text):
                out.append((m.start(), m.end(), EMAIL, [EMAIL if sure else ABSTAIN, EMAIL if " dot " in m.group().lower() or "@" in m.group() else ABSTAIN, EMAIL if re.search(r"[\d._+]", m.group()) else ABSTAIN]))
                taken.append((m.start(), m.end()))
    for m in address_matches(text, [(0, len(text))] if lines is None else lines):
        before = words_before(text, m.start(), 3)
        out.append((m.start(), m.end(), ADDRESS, [ADDRESS if any(c.isdigit() for c in m.group()) else NONE, ADDRESS if set(before) & HOME_SET else ABSTAIN, ADDRESS if "," in m.group() or "،" in m.group() else ABSTAIN, NONE if before and before[-1] in OTHER_SET else ABSTAIN]))
        taken.append((m.start(), m.end()))
    free = lambda s, e: all(e <= a or s >= b for a, b in taken)
    for first, r in ((CODE_START, CODE), (NUMBER_START, NUMBER)):
        for m in starts(first, r, text):
            if free(m.start(), m.end()) and not DATE.fullmatch(m.group()):
                out.append((m.start(), m.end(), ID if r is CODE else PHONE, number_votes(text, m.start(), m.end())))
                if r is CODE:
                    taken.append((m.start(), m.end()))
    for m in NAMES.finditer(text):
        looked_up, may_name, words = run_of(m.group())
        asked |= looked_up
        if not may_name and not any(w in lists.names for w in words) and not follows_title(text, m.start()):
            continue  # no part of it is known, an initial, or after a title
        for s, e in name_spans(text, m.start(), m.end(), lists):
            if free(s, e):
                out.append((s, e, NAME, name_votes(text, s, e, lists)))
    if not text.isascii() and ARABIC.search(text):
        for m in ARABIC_BEFORE.finditer(text):
            asked.update(m.group(1).split())
            s, e = arabic_name(text, m.start(1), m.end(1), lists)
            if e > s and free(s, e):
                out.append((s, e, NAME, name_votes(text, s, e, lists)))
                taken.append((s, e))
    return out


@lru_cache(1 << 16)
def run_of(run: str) -> tuple[frozenset[str], bool, tuple[str, ...]]:
    """Of a run of capitalised words: the forms it is looked up in, whether it holds an initial or a title, and its words as names."""
    words = re.findall(r"[^\s,]+", run)
    plain = [w.strip(".,").casefold() for w in words]
    return frozenset().union(*map(forms, words)), any(INITIAL.fullmatch(w) or w.lower().rstrip(".:=") in TITLE_SET | NAME_SET for w in words), tuple(w[:-2] if w.endswith(("'s", "’s")) else w for w in plain)


def follows_title(text: str, start: int) -> bool:
    before = words_before(text, start, 1)
    return bool(before) and before[0] in TITLE_OR_NAME


def name_spans(text: str, s: int, e: int, lists: Lists) -> list[tuple[int, int]]:
    """The parts of a run of capitalised words that may be a name: titles, roles and common words at its ends go; two names joined by a comma part."""
    words = [(m.start() + s, m.end() + s) for m in re.finditer(r"[^\s,]+", text[s:e])]
    known = [_known(text[a:b], lists) for a, b in words]
    runs: list[list[int]] = []
    for k, (a, b) in enumerate(words):
        w = text[a:b]
        ok = known[k] or re.fullmatch(rf"[{_UP}]\.", w) or w.lower() in ("bin", "ibn", "bint", "de", "del", "von", "van", "la", "al", "da", "di", "el")
        title = w.lower().rstrip(".") in TITLE_SET | NAME_SET and not re.fullmatch(rf"[{_UP}]\.", w)
        unknown = w.casefold().rstrip(".") not in lists.common
        if not title and (ok or unknown and w[0].isupper()):
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
    out = []
    for run in runs:
        while run and not known[run[0]] and (text[words[run[0]][0] : words[run[0]][1]].islower()):
            run = run[1:]
        if not run:
            continue
        titled = (words_before(text, words[run[0]][0], 1) or [""])[0] in TITLE_SET | NAME_SET
        initial = len(run) > 1 and any(re.fullmatch(rf"[{_UP}]\.", text[slice(*words[k])]) for k in run)
        if not any(known[k] for k in run) and not titled and not initial:
            continue
        a, b = words[run[0]][0], words[run[-1]][1]
        if text[b - 2 : b] in ("'s", "’s"):
            b -= 2
        if len(run) == 1 and not titled and not known[run[0]]:
            continue
        out.append((a, b))
    return out


def _known(w: str, lists: Lists) -> bool:
    w = w.strip(".,").casefold()
    w = w[:-2] if w.endswith(("'s", "’s")) else w
    return len(w) > 1 and w in lists.names


def arabic_name(text: str, s: int, e: int, lists: Lists) -> tuple[int, int]:
    end, n = s, 0
    for m in re.finditer(r"[ء-ي]+", text[s:e]):
        w = m.group()
        if w in lists.names or w in ARABIC_PARTICLES and n:
            n += 1
            if w not in ARABIC_PARTICLES:
                end = s + m.end()
        else:
            break
    return s, end


FEATURES = 1 << 13


@lru_cache(1 << 14)
def vote_features(kind: int, votes: tuple[int, ...]) -> list[int]:
    return [zlib.crc32(x.encode()) % FEATURES for x in (f"k{kind}", *(f"v{kind}{i}{x}" for i, x in enumerate(votes)))]


def features(text: str, s: int, e: int, kind: int, votes: list[int]) -> list[int]:
    """Hashed features of a candidate: its votes, shape and the words around it."""
    v = text[s:e]
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", v)))[:24]
    before, after = words_before(text, s, 2), [w.lower() for w in WORD.findall(text[e : e + 24])[:1]]
    names = [f"s{kind}{shape}", *(f"b{kind}{w}" for w in before[-1:]), *(f"B{kind}{w}" for w in before), *(f"a{kind}{w}" for w in after), f"l{kind}{min(len(v) // 4, 12)}", f"p{kind}{text[max(0, s - 1) : s]!r}"]
    known = vote_features(kind, tuple(votes))
    return [known[0], zlib.crc32(names[0].encode()) % FEATURES, *known[1:], *(zlib.crc32(x.encode()) % FEATURES for x in names[1:])]


def vote_model(patterns: list[tuple[tuple[int, ...], int]], allowed: tuple[int, ...], rounds: int = 30) -> dict[tuple[int, ...], np.ndarray]:
    """Expectation-maximisation over vote patterns (Dawid and Skene): class probabilities of each pattern.

    A labeler's reliability is the probability of each of its votes, abstaining included, given the class.
    """
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], "float64")
    k = len(allowed)
    q = np.full((len(votes), k), 0.15)
    for c, t in enumerate(allowed):
        q[:, c] += (votes == t).sum(1)
    q /= q.sum(1, keepdims=True)
    values = (ABSTAIN, *range(len(TYPES)))
    for _ in range(rounds):
        w = q * n[:, None]
        prior = (w.sum(0) + 1) / (w.sum() + k)
        log = np.tile(np.log(prior), (len(votes), 1))
        for j in range(votes.shape[1]):
            for x in values:
                hit = votes[:, j] == x
                p = (w[hit].sum(0) + (2.0 if x in allowed else 1.0) * 0.5) / (w.sum(0) + 4)
                for c, t in enumerate(allowed):  # a labeler that votes is taken to be better than chance
                    if x != ABSTAIN and t == x:
                        p[c] = max(p[c], p.max())
                log[hit] += np.log(np.maximum(p, 1e-9))
        q = np.exp(log - log.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
    out = {}
    for (p, _), x in zip(patterns, q):
        full = np.zeros(len(TYPES))
        full[list(allowed)] = x
        out[p] = full
    return out


ALLOWED = {EMAIL: (NONE, EMAIL), PHONE: (NONE, PHONE, ID), ID: (NONE, PHONE, ID), ADDRESS: (NONE, ADDRESS), NAME: (NONE, NAME)}


class SpanClassifier:
    """Softmax regression on hashed features, fitted to class probabilities."""

    def __init__(self, rows: list[list[int]], target: np.ndarray, rounds: int = 250, rate: float = 0.5, decay: float = 1e-4):
        self.w = np.zeros((FEATURES, len(TYPES)), "float32")
        if not rows:
            return
        at = np.concatenate([np.array(r) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        square = np.full((FEATURES, 1), 1e-6)
        order = np.argsort(at, kind="stable")
        at_o, owner_o = at[order], owner[order]
        first = np.flatnonzero(np.r_[True, at_o[1:] != at_o[:-1]])
        starts = np.r_[0, np.cumsum([len(r) for r in rows])[:-1]]
        for _ in range(rounds):
            y = np.add.reduceat(self.w[at], starts)
            p = np.exp(y - y.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = np.add.reduceat((p - target)[owner_o], first) / len(rows)
            step = np.zeros_like(self.w)
            step[at_o[first]] = g
            step += decay * self.w
            square += (step * step).mean(1, keepdims=True)
            self.w -= (rate * step / np.sqrt(square)).astype("float32")

    def probabilities(self, rows: pa.ListArray, most: int = 50_000) -> np.ndarray:
        """Class probabilities of candidates, each with its features; no more than ``most`` at a time."""
        out = [np.zeros((0, len(TYPES)), "float32")]
        for i in range(0, len(rows), most):
            part = rows.slice(i, most)
            at = part.flatten().to_numpy()
            y = np.add.reduceat(self.w[at], np.r_[0, np.cumsum(part.value_lengths().to_numpy())[:-1]])
            p = np.exp(y - y.max(1, keepdims=True))
            out.append(p / p.sum(1, keepdims=True))
        return np.concatenate(out)


SPAN = "struct<s:int,e:int,kind:int,votes:array<int>,features:array<int>>"


def proposed(df: DataFrame, keys: list[str], text: str, lists: Lists, at: str | None = None, more: bool = False) -> DataFrame:
    """(keys, spans, asked): the candidates of each text with votes and features, offsets as stored, and the words that aren't on the lists; texts without any are left out.

    With ``more``, the columns _names and _common hold further words of the lists for each text.
    """
    has = F.col(at) if at else F.lit(None).cast("array<int>")
    further = [F.col(c) if more else F.lit(None).cast("array<string>").alias(c) for c in ("_names", "_common")]
    src = df.select(*keys, F.col(text).alias("_text"), has.alias("_at"), *further).where(F.col("_text").isNotNull())
    kinds = dict(src.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folds = [fold(t) for t in b.column("_text").to_pylist()]
            texts = [t for t, _ in folds]
            lows = [t.lower() for t in texts]
            each = zip(folds, lows, address_lines(texts, lows), b.column("_at"), *([b.column(c).to_pylist() for c in ("_names", "_common")] if more else ()))
            kept, flat, sizes, absent = [], [], [], []
            for i, ((plain, where), low, lines, stored, *further) in enumerate(each):
                m = stored.values.to_numpy(zero_copy_only=False) if stored.is_valid else None
                asked: set[str] = set()
                own = Lists(*[Both(x, set(y)) for x, y in zip((lists.names, lists.common), further)]) if more else lists
                spans = candidates(plain, own, asked, low, lines)
                missing = [] if more else lists.missing(asked)
                if spans or missing:
                    kept.append(i)
                    sizes.append(len(spans))
                    absent.append(missing)
                for s, e, kind, votes in spans:
                    a, z = (s, e) if where is None else (where[s], where[e - 1] + 1)
                    if m is not None:
                        a, z = int(m[a]), int(m[z])
                    flat.append((a, z, kind, votes, features(plain, s, e, kind, votes)))
            columns = list(zip(*flat)) or [()] * 5
            spans = pa.StructArray.from_arrays([*(pa.array(c, "int32") for c in columns[:3]), *(pa.array(c, pa.list_(pa.int32())) for c in columns[3:])], ["s", "e", "kind", "votes", "features"])
            of_text = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), "int32"), spans)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(kept, "int64")) for k in keys), of_text, pa.array(absent, pa.list_(pa.string()))], names=[*keys, "spans", "asked"])

    return (src if more else spread(src)).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", spans array<{SPAN}>, asked array<string>")


def all_proposed(df: DataFrame, keys: list[str], text: str, at: str | None = None) -> DataFrame:
    """(keys, spans): the candidates of each text by the whole lists.

    Frequent words are at hand in every worker. The others of a text are joined with the rest of the lists, and the texts
    that hold some of those are read again with them; only they are shuffled.
    """
    lists, rest = learned_lists(df, text)
    first = cut(proposed(df, keys, text, lists, at))
    words = may_contain(first.select(*keys, F.explode("asked").alias("w")), "w", rest, "w").join(rest, "w")
    hits = cut(words.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.collect_set(F.when(F.col("name"), F.col("w"))).alias("_names"), F.collect_set(F.when(~F.col("name"), F.col("w"))).alias("_common")))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    hashed = hits.select(F.xxhash64(*[f"_{i}" for i in range(len(keys))]).alias("_key"))
    again = proposed(may_contain(df.withColumn("_key", F.xxhash64(*keys)), "_key", hashed, "_key").join(hits, same), keys, text, lists, at, more=True)
    return cut(first.join(hits, same, "left_anti").unionByName(again).where(F.size("spans") > 0).select(*keys, "spans"))


def personal_spans(df: DataFrame, keys: list[str], text: str = "text", at: str | None = None, sample: int = 30_000, least: float = 0.5) -> DataFrame:
    """(keys, start_pos, end_pos, pii_type): the personal spans of every distinct row, without overlaps.

    All candidates count in the estimate of the labelers' reliabilities; the span classifier is fitted to about ``sample`` of
    them, those of texts chosen by a hash of their keys. Null and empty texts have no spans; rows that repeat keys and text are one.
    """
    src = df.select(*keys, text, *([at] if at else []))
    found = all_proposed(src, keys, text, at)
    each = found.select(F.explode("spans").alias("x"))
    counted = each.groupBy(F.col("x.kind").alias("kind"), F.col("x.votes").alias("votes")).agg(F.count("*").alias("n")).collect()  # a few vote patterns
    meaning = {}
    for group in ((EMAIL,), (PHONE, ID), (ADDRESS,), (NAME,)):
        pooled: Counter = Counter()
        for r in counted:
            if r.kind in group:
                pooled[tuple(r.votes)] += r.n
        if pooled:
            model = vote_model(list(pooled.items()), ALLOWED[group[0]])
            meaning.update({(k, p): v for k in group for p, v in model.items()})
    total = sum(r.n for r in counted)
    share = min(1.0, sample / max(1, total))
    chosen = found.where(F.pmod(F.xxhash64(*keys, F.lit(3)), F.lit(1_000_003)) < share * 1_000_003).select(F.explode("spans").alias("x")).select("x.kind", "x.votes", "x.features").collect()  # about the sample
    chosen.sort(key=lambda r: (r.kind, r.votes, r.features))
    net = SpanClassifier([list(r.features) for r in chosen], np.array([meaning[(r.kind, tuple(r.votes))] for r in chosen]))
    kinds = dict(found.dtypes)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("spans")
            flat = column.flatten()
            start, end = (flat.field(c).to_numpy() for c in ("s", "e"))
            owner = np.repeat(np.arange(b.num_rows), column.value_lengths().to_numpy())
            p = net.probabilities(flat.field("features"))
            kind, sure = p.argmax(1), p.max(1)
            use = np.flatnonzero((kind != NONE) & (sure >= least))
            order = use[np.lexsort((-kind[use], start[use], (start - end)[use], -sure[use], owner[use]))]  # the surest first, then the longest
            rows, last, taken = [], -1, []
            for i, k, s, e in zip(order.tolist(), owner[order].tolist(), start[order].tolist(), end[order].tolist()):
                if k != last:
                    last, taken = k, []
                if all(e <= a or s >= z for a, z in taken):
                    taken.append((s, e))
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(owner[rows])) for k in keys), pa.array(start[rows]), pa.array(end[rows]), pa.array([TYPES[t] for t in kind[rows]], "string")], names=[*keys, "start_pos", "end_pos", "pii_type"])

    out = found.mapInArrow(decide, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start_pos int, end_pos int, pii_type string")
    return out.distinct()  # whole texts aren't shuffled to find repeated rows; their spans are


def masked(df: DataFrame, spans: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``df`` with ``masked``: its text with each span replaced by its type in brackets, the rest as it is."""
    per = spans.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", "pii_type"))).alias("_spans"))
    zero = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["done"], F.substring(F.col(text), a["at"] + 1, x["start_pos"] - a["at"]), F.lit("["), x["pii_type"], F.lit("]")).alias("done"), x["end_pos"].alias("at"))
    built = F.aggregate("_spans", zero, step, lambda a: F.concat(a["done"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return df.join(per, keys, "left").withColumn("masked", F.when(F.col("_spans").isNull(), F.col(text)).otherwise(built)).drop("_spans")
