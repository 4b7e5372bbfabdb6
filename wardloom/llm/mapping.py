"""Freely typed values mapped to the entries of a canonical list (problem 1).

Values are deduplicated and normalised; candidates come from an inverted index of the list's character n-grams; the
cosine, weighted by the rarity of each n-gram in the list, scores them; the best entry is accepted above a threshold and with
a margin to the second. What fits none is reported as unmatched.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.session import cut

UNMATCHED = "UNMATCHED"
#: Words around a heading that name nothing.
FILLERS = frozenset({"the", "section", "today", "notes", "cont"})
# Signs that are typed or scanned for each other, and one sign for each group.
CONFUSED = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "9": "g", "|": "l"})
# Spellings of Arabic letters that are typed for each other.
ARABIC = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ئ": "ي", "ة": "ه", "ؤ": "و", "ک": "ك", "ـ": None})
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+\.?")
NUMBERING = regex.compile(r"^[\s\p{P}\p{S}]*(?:\d{1,3}\s*[.):]\s*)+")
#: Accents of Latin, Greek and Cyrillic letters, Arabic vowel signs, and invisible signs.
ACCENT = regex.compile(r"[\u0300-\u036f\u064b-\u065f]|\p{Cf}")


def tokens(value: str) -> list[str]:
    """Folded words; a word cut short keeps its period."""
    s = unicodedata.normalize("NFKD", value)
    s = unicodedata.normalize("NFC", ACCENT.sub("", s)).casefold().translate(ARABIC)
    s = NUMBERING.sub("", s)
    out = []
    for t in TOKEN.findall(s):
        body = t.rstrip(".")
        out.append((body if body.isdigit() else body.translate(CONFUSED).replace("rn", "m")) + t[len(body) :])
    return out


def joined(words: list[str]) -> str:
    return "".join(w.rstrip(".") for w in words)


def parts(value: str | None, fillers: frozenset[str]) -> list[list[str]]:
    """The words of a value, or of each of its sides where a slash parts them, without fillers at their ends."""
    out = []
    for side in regex.split(r"\s/\s", value or ""):
        words = tokens(side)
        while words and words[0].rstrip(".") in fillers:
            words = words[1:]
        while words and words[-1].rstrip(".") in fillers:
            words = words[:-1]
        if joined(words):
            out.append(words)
    return out


def grams(form: str) -> Counter:
    """Character 2- and 3-grams of a form between boundary signs."""
    padded = f"^{form}$"
    return Counter(padded[i : i + n] for n in (2, 3) for i in range(max(1, len(padded) - n + 1)))


class Index:
    """Inverted index of the n-grams of a list's names.

    ``rarity`` has the number of forms of the whole list that hold each n-gram, ``vocabulary`` all its words; ``names`` may be
    a block of the list.
    """

    def __init__(self, names: list[tuple[str, str]], rarity: dict[str, int], n_forms: int, vocabulary: frozenset[str]):
        self.rare = math.log1p(2.0 * n_forms)
        self.idf = {g: math.log1p(n_forms / n) for g, n in rarity.items()}
        self.vocabulary = vocabulary
        self.fillers = fillers_of(vocabulary)
        rows = sorted({(e, f, tuple(w.rstrip(".") for w in words)) for e, n in names for f, words in forms_of(n, self.fillers)})
        self.entries = [e for e, *_ in rows]
        self.words = [w for *_, w in rows]
        post: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.vectors = []
        holds: dict[str, list[int]] = defaultdict(list)
        for k, (_, form, words) in enumerate(rows):
            v = self.weighed(form)
            self.vectors.append(v)
            for g, w in v.items():
                post[g].append((k, w))
            for w in set(words):
                holds[w].append(k)
        self.post = {g: (np.array([k for k, _ in p]), np.array([w for _, w in p])) for g, p in post.items()}
        self.holds, self.sorted_words = holds, sorted(holds)

    def weighed(self, form: str) -> dict[str, float]:
        v = {g: math.sqrt(n) * self.idf.get(g, self.rare) for g, n in grams(form).items()}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {g: w / size for g, w in v.items()}

    def completing(self, body: str) -> Iterator[str]:
        """All words of the block that begin with ``body``."""
        for w in self.sorted_words[bisect_left(self.sorted_words, body) :]:
            if not w.startswith(body):
                return
            yield w

    def candidates(self, value: str, least: float) -> list[tuple[str, float, int]]:
        """(entry, score, signs) of every entry with a score of at least ``least``, the best of its names and of the value's parts.

        A word cut short counts, for each name, as that name's word which begins with it.
        """
        best: dict[str, tuple[float, int]] = {}

        def note(k: int, score: float, size: int) -> None:
            if score >= least and (score, size) > best.get(self.entries[k], (0.0, 0)):
                best[self.entries[k]] = score, size

        for words in parts(value, self.fillers):
            form = joined(words)
            score = np.zeros(len(self.entries))
            for g, w in self.weighed(form).items():
                if g in self.post:
                    ids, weights = self.post[g]
                    score[ids] += w * weights
            for k in np.flatnonzero(score >= least):
                note(int(k), float(score[k]), len(form))
            bodies = [w.rstrip(".") for w in words]
            short = {i for i, (w, b) in enumerate(zip(words, bodies)) if w != b and len(b) >= 3 and b not in self.vocabulary}
            for k in {k for i in short for w in self.completing(bodies[i]) for k in self.holds[w]}:
                whole = "".join(next((w for w in self.words[k] if w.startswith(b)), b) if i in short else b for i, b in enumerate(bodies))
                other = self.vectors[k]
                note(k, sum(w * other.get(g, 0.0) for g, w in self.weighed(whole).items()), len(whole))
        return [(e, s, n) for e, (s, n) in best.items()]


def fillers_of(vocabulary: frozenset[str]) -> frozenset[str]:
    return frozenset(f.translate(CONFUSED) for f in FILLERS) - vocabulary


def forms_of(name: str, fillers: frozenset[str]) -> list[tuple[str, list[str]]]:
    """(form, words) of a name: its first part, and the whole of it."""
    whole = tokens(name)
    return [(f, w) for w in (*parts(name, fillers)[:1], whole) if (f := joined(w))]


def scored(values: DataFrame, names: DataFrame, least: float, block_names: int = 50_000) -> DataFrame:
    """(value, found): ``found`` has entry, score and size of every candidate with a score of at least ``least``, best first; one row for each distinct value.

    ``values`` has ``value``, ``names`` has ``entry`` and ``name``. The list goes to the executors in blocks of about
    ``block_names``; what all blocks need of the whole list is its words and the count of each n-gram, which hardly grow with it.
    """
    listed = cut(names.where("entry is not null and name is not null").select("entry", "name").distinct())
    n_names = listed.count()

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": [w.rstrip(".") for n in b["name"] for w in tokens(n)]})

    vocabulary = frozenset(r.word for r in listed.mapInPandas(words, "word string").distinct().collect())
    fillers = fillers_of(vocabulary)

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"form": [f for n in b["name"] for f, _ in forms_of(n, fillers)]})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(g for f in b["form"] for g in grams(f))
            yield pd.DataFrame(list(c.items()), columns=["gram", "n"])

    distinct = cut(listed.mapInPandas(forms, "form string").distinct())
    n_forms = distinct.count()
    rarity = {r.gram: r.n for r in distinct.mapInPandas(counted, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = values.select("value").where("value is not null").distinct().repartition(tasks)  # small rows with much work each: not to be merged into one task
    blocks = max(1, math.ceil(n_names / block_names))
    asked = cut(asked) if blocks > 1 else asked
    out = None
    for b in range(blocks):
        rows = [(r.entry, r.name) for r in listed.where(F.pmod(F.xxhash64("entry", "name"), F.lit(blocks)) == b).collect()]  # about block_names

        def run(batches: Iterator[pd.DataFrame], rows=rows) -> Iterator[pd.DataFrame]:
            index = Index(rows, rarity, n_forms, vocabulary)
            for x in batches:
                found = [[{"entry": e, "score": s, "size": n} for e, s, n in index.candidates(v, least)] for v in x["value"]]
                yield pd.DataFrame({"value": x["value"], "found": found})

        part = asked.mapInPandas(run, "value string, found array<struct<entry:string,score:double,size:int>>")
        out = part if out is None else out.unionByName(part)
    found = F.col("found")
    if blocks > 1:
        each = out.select("value", F.explode_outer("found").alias("f")).groupBy("value", "f.entry").agg(F.max(F.struct("f.score", "f.size")).alias("m"))
        out = each.groupBy("value").agg(F.filter(F.collect_list(F.struct("entry", "m.score", "m.size")), lambda x: x["entry"].isNotNull()).alias("found"))
    ordered = F.array_sort(found, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["entry"] < b["entry"], -1).when(a["entry"] > b["entry"], 1).otherwise(0))
    return out.select("value", ordered.alias("found"))


def accepted(found: Column, threshold: float, margin: float, short: int = 4) -> Column:
    """The best candidate if it is good and clear, else null. Forms of up to ``short`` signs must be exact."""
    best, second = F.get(found, F.lit(0)), F.coalesce(F.get(found, F.lit(1))["score"], F.lit(0.0))
    return F.when((best["score"] >= threshold) & (best["score"] - second >= margin) & ((best["size"] > short) | (best["score"] >= 0.999)), best)


def mapped(df: DataFrame, key: str, value: str, names: DataFrame, threshold: float = 0.5, margin: float = 0.06, also: str | None = None, also_least: float = 0.2, block_names: int = 50_000) -> DataFrame:
    """(key, canonical, score): one row for each distinct key; ``UNMATCHED`` where no entry fits.

    ``value`` decides. ``also``, an array of further names of the row, only helps where the value alone is not clear: then
    the entry with most support of the further names is taken, if the value itself has a score of at least
    ``also_least`` with it. Null, empty and sign-only values are unmatched unless the further names settle them. A key
    whose rows differ keeps the one with the best score. Ties between entries are not clear. An empty list matches nothing.
    """
    has = [F.col(also).alias("more")] if also else [F.lit(None).cast("array<string>").alias("more")]
    src = df.select(F.col(key).alias("key"), F.col(value).alias("value"), *has).where("key is not null").dropDuplicates(["key", "value", "more"])
    asked = src.select("value")
    if also:
        asked = asked.unionByName(src.select(F.explode("more").alias("value")))
    # a second candidate below threshold - margin can't make the best unclear
    scores = cut(scored(asked, names, also_least if also else threshold - margin, block_names))
    best = accepted(F.col("found"), threshold, margin)
    out = src.join(scores.select("value", "found", best["entry"].alias("entry"), best["score"].alias("score")), "value", "left")
    if also:
        votes = src.select("key", "value", F.explode("more").alias("m")).join(scores.select(F.col("value").alias("m"), best["entry"].alias("entry"), best["score"].alias("s")).where("entry is not null"), "m").groupBy("key", "value", "entry").agg(F.sum("s").alias("support"))
        own = scores.select("value", F.explode("found").alias("f")).select("value", "f.entry", F.col("f.score").alias("own"))
        led = votes.join(own, ["value", "entry"], "left").where(F.coalesce("own", F.lit(0.0)) >= also_least)
        led = led.groupBy("key", "value").agg(F.max(F.struct("support", "own", "entry")).alias("v")).select("key", F.col("value").alias("_v"), F.col("v.entry").alias("led"), F.col("v.own").alias("led_score"))
        out = out.withColumnRenamed("key", "_k").join(led, (F.col("_k") == F.col("key")) & F.col("value").eqNullSafe(F.col("_v")), "left").drop("key").withColumnRenamed("_k", "key")
        out = out.select("key", F.coalesce("entry", "led").alias("entry"), F.when(F.col("entry").isNull() & F.col("led").isNotNull(), F.col("led_score")).otherwise(F.col("score")).alias("score"))
    pick = F.max(F.struct(F.col("entry").isNotNull().alias("has"), "score", "entry")).alias("p")
    return out.groupBy("key").agg(pick).select(F.col("key").alias(key), F.coalesce("p.entry", F.lit(UNMATCHED)).alias("canonical"), F.col("p.score").alias("score"))
