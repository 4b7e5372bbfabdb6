"""Text that was decoded with the wrong encoding: found, and given back where possible (problem 4).

A chain says what happened: the bytes of one encoding were read as another's, once or twice. For every text with signs
beyond ASCII, each chain that could have made it proposes the text before; a character model of all texts weighs
proposal against text as stored. The chain of a text is latent: expectation-maximisation estimates how often each
chain happened in each source and field, which pools the weak evidence of single signs across records, and each
record is repaired by the posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.lookalike import character_table
from wardloom.session import cut, spread

#: Chains by name: the encodings of the bytes and of the reading, from the first damage to the last.
CHAINS = {
    "utf8>cp1252": [("utf-8", "cp1252")], "utf8>mac": [("utf-8", "mac_roman")], "utf8>cp1256": [("utf-8", "cp1256")], "utf8>cp1251": [("utf-8", "cp1251")],
    "utf8>cp437": [("utf-8", "cp437")], "utf8>cp850": [("utf-8", "cp850")], "utf8>cp874": [("utf-8", "cp874")],
    "utf8>cp1252 twice": [("utf-8", "cp1252")] * 2, "utf8>mac twice": [("utf-8", "mac_roman")] * 2, "utf8>cp1252, utf8>mac": [("utf-8", "cp1252"), ("utf-8", "mac_roman")],
    "cp1256>cp1252": [("cp1256", "cp1252")], "cp1252>cp437": [("cp1252", "cp437")], "cp1252>cp850": [("cp1252", "cp850")], "cp1252>mac": [("cp1252", "mac_roman")],
    "mac>cp1252": [("mac_roman", "cp1252")], "cp1252>cp1251": [("cp1252", "cp1251")], "cp1252>cp1256": [("cp1252", "cp1256")], "cp850>cp1252": [("cp850", "cp1252")],
    "cp874>cp1252": [("cp874", "cp1252")], "cp1251>cp1252": [("cp1251", "cp1252")], "gbk>cp1252": [("gb18030", "cp1252")], "sjis>cp1252": [("cp932", "cp1252")],
    "euc_jp>cp1252": [("euc_jp", "cp1252")], "big5>cp1252": [("cp950", "cp1252")],
}
#: Signs that stand for bytes nobody can give back, and control signs that no proper text has.
LOST = r"[�\x80-\x84\x86-\x9f]"
MULTIBYTE = ("gb18030", "cp932", "euc_jp", "cp950")
ASCII = "".join(map(chr, range(128)))
BEYOND = re.compile(r"[^\x00-\x7f]")
BIGRAMS = 1 << 20
CONTROL = 1 << 16


@lru_cache(maxsize=None)
def byte_table(encoding: str) -> dict[int, int]:
    """For ``str.translate``: a sign to the Latin-1 sign of its byte; what has no byte is not in it. Bytes that the encoding leaves undefined stand as control signs."""
    table = {c: c for c in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            pass
    return table


class _Bytes(dict):
    def __missing__(self, c: int) -> int:
        return c if c < 0x80 else 0x2603


@lru_cache(maxsize=None)
def to_bytes(encoding: str) -> _Bytes:
    return _Bytes({c: c for c in range(0x80)} | byte_table(encoding))


@lru_cache(maxsize=None)
def utf8_runs(read: str) -> re.Pattern:
    """Characters of UTF-8 in a row, in the signs that an encoding gives to their bytes."""
    signs = lambda low, high: re.escape("".join(chr(c) for c, b in byte_table(read).items() if low <= b <= high))
    two, three, four, more = signs(0xC2, 0xDF), signs(0xE0, 0xEF), signs(0xF0, 0xF4), f"[{signs(0x80, 0xBF)}]"
    return re.compile(f"[{two}{three}{four}](?:(?<=[{two}]){more}|(?<=[{three}]){more}{{2}}|(?<=[{four}]){more}{{3}})(?:[{two}]{more}|[{three}]{more}{{2}}|[{four}]{more}{{3}})*")


def undo(text: str, true: str, read: str) -> list[tuple[int, int, str, list[int]]]:
    """(start, end, text before, width of each of its signs) of the parts of ``text`` that ``read`` may have made of ``true``."""
    out = []
    if true == "utf-8":
        for m in utf8_runs(read).finditer(text):
            try:
                was = m.group().translate(to_bytes(read)).encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            out.append((m.start(), m.end(), was, [len(c.encode("utf-8")) for c in was]))
        return out
    raw = text.translate(to_bytes(read))
    if true not in MULTIBYTE:
        for m in re.finditer("[\x80-\xff]+(?:[^\\s\x80-\xff\u2603]*[\x80-\xff]+)*", raw):
            try:
                was = m.group().encode("latin-1").decode(true)
            except UnicodeDecodeError:
                continue
            out.append((m.start(), m.end(), was, [1] * len(was)))
        return out
    for m in re.finditer("[\x80-\xff](?:[\x00-\xff]*[\x80-\xff])?[\x40-\x7e]?", raw):  # a last byte may be in the ASCII range
        for part in dict.fromkeys((m.group(), m.group().rstrip(ASCII))):
            try:
                was = part.encode("latin-1").decode(true)
                widths = [len(c.encode(true)) for c in was]
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            if sum(widths) == len(part):
                out.append((m.start(), m.start() + len(part), was, widths))
                break
    return out


def undo_chain(text: str, chain: str) -> list[tuple[int, int, str, list[int]]]:
    """As ``undo``, over all steps of a chain, the last damage first; only parts that every step has in them."""
    steps = list(reversed(CHAINS[chain]))
    parts = undo(text, *steps[0])
    for step in steps[1:]:
        parts = _again(text, parts, step)
    return [p for p in parts if text[p[0] : p[1]] != p[2]]


@lru_cache(1 << 17)
def undone_word(word: str, chain: str) -> tuple[tuple[int, int, str, list[int]], ...]:
    """As ``undo_chain`` of a word between blanks; the same for every model, and words come again and again."""
    return tuple(undo_chain(f" {word} ", chain))


def _again(text: str, parts: list[tuple[int, int, str, list[int]]], step: tuple[str, str]) -> list[tuple[int, int, str, list[int]]]:
    out = []
    for start, _, was, widths in parts:
        at = np.concatenate([[start], start + np.cumsum(widths)]).tolist()
        for s, e, older, w in undo(was, *step):
            k, spans = s, []
            for n in w:
                spans.append(at[k + n] - at[k])
                k += n
            out.append((at[s], at[e], older, spans))
    return out


@lru_cache(maxsize=1)
def same_look() -> dict[int, str]:
    return {ord(c): t for c, t in character_table().items()}


class CharacterModel:
    """Log probability of strings by hashed character pairs; its size is fixed."""

    def __init__(self, pairs: np.ndarray, single: np.ndarray):
        total = single.sum()
        self.own = np.log((single + 0.05) / (total + 0.05 * len(single))).astype("float32")
        self.pairs, self.single = pairs.astype("float32"), single.astype("float32")
        self.gains: dict[tuple[str, str, str, str], float] = {}
        self.words: dict[str, tuple[str, ...]] = {}
        self.logs: dict[str, float] = {}

    @staticmethod
    def codes(text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32").astype("int64")
        return np.where((c >= 48) & (c <= 57), 48, c) % CONTROL

    @staticmethod
    def pair(c: np.ndarray) -> np.ndarray:
        return ((c[:-1] * 40503 + c[1:]) * 2654435761 >> 8) % BIGRAMS

    def score(self, text: str) -> float:
        known = self.logs
        total = 0.0
        for pair in map(str.__add__, text, text[1:]):
            x = known.get(pair)
            if x is None:
                if len(known) > 500_000:
                    known.clear()
                x = known[pair] = self.pair_score(pair)
            total += x
        return total

    def pair_score(self, pair: str) -> float:
        a, b = (48 if 48 <= x <= 57 else x % CONTROL for x in map(ord, pair))  # as ``codes`` and ``pair``
        first, second = self.single[a], self.single[b]
        seen = min(self.pairs[((a * 40503 + b) * 2654435761 >> 8) % BIGRAMS], first, second)  # pairs that share a place don't lend to rare signs
        return float(np.log((seen + 3 * np.exp(self.own[b])) / (first + 3)))

    def gain(self, before: str, stored: str, was: str, after: str) -> float:
        """How much better ``was`` reads than ``stored``; words come again and again, so the last ones are kept."""
        key = before, stored, was, after
        known = self.gains.get(key)
        if known is None:
            if len(self.gains) > 300_000:
                self.gains.clear()
            plain = stored.translate(same_look())
            best = self.score(before + stored + after)
            if plain != stored:  # a disguised letter is no damage
                best = max(best, self.score(before + plain + after) - 1)
            known = self.gains[key] = self.score(before + was + after) - best
        return known


_KEPT: dict[int, CharacterModel] = {}


def kept(model: CharacterModel) -> CharacterModel:
    """One copy of a model, with what it remembers, for all tasks of a Python worker."""
    k = hash((model.pairs.sum(dtype="float64"), model.single.tobytes()))
    if k not in _KEPT:
        if len(_KEPT) > 1:
            _KEPT.clear()
        _KEPT[k] = model
    return _KEPT[k]


def character_model(texts: DataFrame, text: str = "text") -> CharacterModel:
    """Counted over all ``texts``; what comes to the driver has a fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, single = np.zeros(BIGRAMS, "int64"), np.zeros(CONTROL, "int64")
        part: list[str] = []
        size = 0

        def add() -> None:
            nonlocal pairs, single, size
            c = CharacterModel.codes("\n".join(["", *part, ""]))
            pairs += np.bincount(CharacterModel.pair(c), minlength=BIGRAMS)
            single += np.bincount(c, minlength=CONTROL)
            part.clear()
            size = 0

        for b in batches:
            for t in b["t"]:
                size += len(t) + 1
                part.append(t)
                if size > 2_000_000:
                    add()
            add()
        i, j = pairs.nonzero()[0], single.nonzero()[0]
        yield pd.DataFrame({"k": np.concatenate([i, j + BIGRAMS]), "n": np.concatenate([pairs[i], single[j]])})

    src = spread(texts.select(F.col(text).alias("t")).where(F.col("t").isNotNull()))
    rows = src.mapInPandas(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BIGRAMS + CONTROL)
    counts[rows["k"].to_numpy("int64")] = rows["n"].to_numpy("float64")
    return CharacterModel(counts[:BIGRAMS], counts[BIGRAMS:])


UTF8_CHAINS = [c for c in CHAINS if CHAINS[c][0][0] == "utf-8"]
OTHER_CHAINS = [c for c in CHAINS if CHAINS[c][0][0] != "utf-8"]
#: The signs that the last reading of a chain gives to bytes beyond ASCII.
READ_SIGNS = {c: frozenset(map(chr, byte_table(CHAINS[c][-1][1]))) for c in CHAINS}
#: Signs that have a byte in an encoding that texts are wrongly read in.
ODD_SIGNS = frozenset(chr(c) for x in OTHER_CHAINS for c in byte_table(CHAINS[x][-1][1]))


@lru_cache(maxsize=None)
def leads(read: str) -> tuple[frozenset[str], frozenset[str]]:
    """The signs that begin, and those that go on, a character of UTF-8 read in another encoding."""
    t = byte_table(read)
    return frozenset(chr(c) for c, b in t.items() if b >= 0xC2), frozenset(chr(c) for c, b in t.items() if b < 0xC0)


def proposals(text: str, model: CharacterModel) -> list[tuple[str, float]]:
    """(chain, log-likelihood ratio to the text as stored) of every chain that helps some line."""
    signs = set(text)
    likely = []
    for c in UTF8_CHAINS:
        read = CHAINS[c][-1][1]
        first, more = leads(read)
        if not first.isdisjoint(signs) and not more.isdisjoint(signs) and utf8_runs(read).search(text):
            likely.append(c)
    helped: set[str] = set()
    for word in () if ODD_SIGNS.isdisjoint(signs) else set(text.split()):
        if word.isascii() or ODD_SIGNS.isdisjoint(word):
            continue
        chains = model.words.get(word)
        if chains is None:
            if len(model.words) > 300_000:
                model.words.clear()
            chains = model.words[word] = tuple(c for c in OTHER_CHAINS if not READ_SIGNS[c].isdisjoint(word) and any(g > 0 for *_, g in weighed_parts(f" {word} ", undone_word(word, c), model)))
        helped.update(chains)
    likely += [c for c in OTHER_CHAINS if c in helped]
    if not likely:
        return []
    lines = [x for x in text.split("\n") if BEYOND.search(x)]
    out = []
    for chain in likely:
        gain = sum(g for x in lines for *_, g in helpful(x, chain, model))
        if gain > 0:
            out.append((chain, gain))
    return out


def gains(line: str, chain: str, model: CharacterModel) -> list[tuple[int, int, str, list[int], float]]:
    """The parts of a line that a chain may have made, each with how much better it reads before."""
    return weighed_parts(line, undo_chain(line, chain), model)


def weighed_parts(line: str, parts: Iterable[tuple[int, int, str, list[int]]], model: CharacterModel) -> list[tuple[int, int, str, list[int], float]]:
    return [(s, e, was, widths, model.gain(line[s - 1] if s else "\n", line[s:e], was, line[e : e + 1] or "\n")) for s, e, was, widths in parts]


def helpful(line: str, chain: str, model: CharacterModel, start_cost: float = 3.0) -> list[tuple[int, int, str, list[int], float]]:
    """The parts of a line that read better before the chain, each with its gain.

    Parts of UTF-8 speak for themselves. Between single-byte encodings every word could be one, so they count in stretches
    of neighbouring words, as long as the whole stretch gains more than ``start_cost``.
    """
    if READ_SIGNS[chain].isdisjoint(line):
        return []
    parts = gains(line, chain, model)
    if CHAINS[chain][0][0] == "utf-8" or len(parts) == 0:
        return [p for p in parts if p[-1] > 0]
    out, first = [], 0
    total = best = 0.0
    last = -1
    for k, p in enumerate([*parts, None]):
        if p is None or total + p[-1] < 0:
            if best > start_cost:
                out += parts[first : last + 1]
            first, total, best, last = k + 1, 0.0, 0.0, k
            continue
        total += p[-1]
        if total > best:
            best, last = total, k
    return out


def weighed(df: DataFrame, key: list[str], text: str, source: str, model: CharacterModel, rounds: int = 3, start: float = 0.002, strength: float = 20.0) -> DataFrame:
    """(key, chain, posterior): the most likely chain of each text that any chain could have made, and how likely one of them did.

    The prior of a chain belongs to the pair of source and field (``key[0]`` names the field); it is shrunk to the field's
    with the weight of ``strength`` texts, so that a source of few records learns from the others. With no ``rounds`` the
    prior stays at ``start``. What comes to the driver is one number for each field and chain.
    """
    src = spread(df.select(*key, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]")))
    kinds = dict(src.dtypes)
    shape = ", ".join(f"{k} {kinds[k]}" for k in key) + ", source string, made array<struct<chain:string,gain:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = kept(model)
        for b in batches:
            rows = [(*r[:-1], [{"chain": c, "gain": g} for c, g in proposals(r[-1], m)]) for r in b.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[*key, "source", "made"])

    found = cut(src.mapInPandas(run, shape))  # texts that no chain could have made count in the priors
    weights = lambda prior: F.transform("made", lambda x: F.struct((prior(x["chain"]) * F.exp(F.least(x["gain"], F.lit(500.0)))).alias("w"), x["chain"].alias("chain")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"])
    post = found.where(F.size("made") > 0).withColumn("v", weights(lambda c: F.lit(start))).withColumn("all", total)
    for _ in range(rounds):
        q = post.select(key[0], "source", F.explode("v").alias("x"), "all").groupBy(key[0], "source", F.col("x.chain").alias("chain")).agg(F.sum(F.col("x.w") / (1 + F.col("all"))).alias("q"))
        own = q.groupBy(key[0], "source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "q"))).alias("own"))  # one entry a chain
        own = cut(found.groupBy(key[0], "source").agg(F.count("*").alias("texts")).join(own, [key[0], "source"], "left"))
        texts = {r[0]: r.n for r in own.groupBy(key[0]).agg(F.sum("texts").alias("n")).collect()}
        sums = own.select(key[0], F.explode("own").alias("chain", "q")).groupBy(key[0], "chain").agg(F.sum("q").alias("q")).collect()
        share = {f"{r[0]}|{r.chain}": strength * (r.q + 0.01) / (texts[r[0]] + 1) for r in sums}
        of_field = F.create_map(*[F.lit(x) for kv in share.items() for x in kv]) if share else F.create_map(F.lit(""), F.lit(0.0))
        prior = lambda c: (F.coalesce(F.col("own")[c], F.lit(0.0)) + F.coalesce(of_field[F.concat_ws("|", F.col(key[0]), c)], F.lit(0.0))) / (F.col("texts") + strength)  # noqa: E731, B023
        post = found.where(F.size("made") > 0).join(own, [key[0], "source"]).withColumn("v", weights(prior)).withColumn("all", total)
    return post.select(*key, F.array_max("v")["chain"].alias("chain"), (F.col("all") / (1 + F.col("all"))).alias("posterior"))


def repaired(df: DataFrame, key: list[str], text: str = "text", source: str = "source", least: float = 0.5, unsure: float = 0.05) -> DataFrame:
    """(key, damaged, restored, text, at): every distinct row of ``df`` with its original text where that can be given back.

    ``at`` has the stored offset of each sign of ``text`` and of its end; it is null where nothing changed. ``damaged`` is true
    if the posterior of having been through any chain is at least ``least``, or if the text holds signs that stand for lost
    bytes; ``restored`` is true if no such sign is left. Null texts stay null and are not damaged; rows that repeat key and
    text are one. ``key[0]`` names the field the text is from.

    The character model is counted twice: over all texts as stored, then over the texts as the first posterior repairs them,
    without those that it is not sure of (between ``unsure`` and ``least``).
    """
    src = df.select(*key, F.coalesce(F.col(source).cast("string"), F.lit("")).alias(source), F.col(text).alias("t")).dropDuplicates([*key, "t"])
    kinds = dict(src.dtypes)
    shape = ", ".join(f"{k} {kinds[k]}" for k in key) + ", damaged boolean, text string, at array<int>"

    def mend(posts: DataFrame, model: CharacterModel) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(*r[:-2], True, *mended(r[-2], r[-1], model)) for r in b[[*key, "t", "chain"]].itertuples(index=False, name=None)]
                yield pd.DataFrame(rows, columns=[*key, "damaged", "text", "at"])

        joined = src.drop(source).join(posts.select(*key, "chain", "posterior"), key, "left")
        sure = F.coalesce(F.col("posterior") >= least, F.lit(False))
        clean = joined.where(~sure).select(*key, F.when(F.col("posterior") >= unsure, F.lit(None)).otherwise(F.lit(False)).alias("damaged"), F.col("t").alias("text"), F.lit(None).cast("array<int>").alias("at"))
        return clean.unionByName(joined.where(sure).mapInPandas(run, shape))

    first = character_model(src, "t")
    model = character_model(mend(cut(weighed(src, key, "t", source, first, rounds=0)), first).where("damaged is not null"))
    out = mend(cut(weighed(src, key, "t", source, model)), model)
    lost = F.coalesce(F.col("text").rlike(LOST), F.lit(False))
    return out.select(*key, (F.coalesce("damaged", F.lit(False)) | lost).alias("damaged"), (~lost).alias("restored"), "text", "at")


def mended(text: str, chain: str, model: CharacterModel) -> tuple[str, list[int]]:
    """The text with the parts repaired that the chain made, and the stored offset of each of its signs and of its end."""
    out: list[str] = []
    at: list[int] = []
    start = 0
    for line in text.split("\n"):
        pos = 0
        for s, e, was, widths, _ in helpful(line, chain, model) if BEYOND.search(line) else ():
            out.append(line[pos:s] + was)
            at += [*range(start + pos, start + s), *(start + s + np.cumsum([0, *widths[:-1]])).tolist()]
            pos = e
        out.append(line[pos:] + "\n")
        at += range(start + pos, start + len(line) + 1)
        start += len(line) + 1
    return "".join(out)[:-1], at


def found(df: DataFrame, key: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """``key`` of each record of which some text was decoded with the wrong encoding."""
    return repaired(df, key, text, source).where("damaged").select(*key).distinct()
