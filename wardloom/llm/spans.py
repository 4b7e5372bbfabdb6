"""Long spans that stand verbatim in more than one record, found through compact windows (problem 9).

The tokens of a text are its overlapping runs of ``span // 2`` characters, each hashed. The min-hash of a window of
``span`` characters is the position of its smallest token hash. Positions that are minimal in some such window are the
nodes of the text's Cartesian tree whose extent holds a whole window; each, with its extent, is a compact window: it stands
for all windows that share its signature. Two equal windows have their minimum at the same place, hence meet in one
signature, so one hash function finds every exact span. Extents that are equal as a whole are settled by one
aggregation; where a signature has several different extents, their windows are compared, again by aggregation: no pairs
are made, and a passage that a third of all records share collapses before the shuffle. Windows count as equal if they
agree in two hashes of 64 bits: that of all their signs, and that of the token which is their minimum. Different ones that
hold the same token, which only near-copies do, agree in the first with a chance of one in 2^64; all others must agree in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.session import cut, may_contain, spread

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
U = np.uint64
PLACE_BITS = 25


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashed:
    """Several texts in one array of code points, with hashes of any of its ranges."""

    def __init__(self, texts: list[str]):
        raw = "".join(texts).encode("utf-32-le", "surrogatepass")
        code = np.frombuffer(raw, "uint32").astype("uint64")
        n = len(code)
        self.length = np.fromiter(map(len, texts), "int64", len(texts))
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]]) if len(texts) else np.zeros(0, "int64")
        step = np.full(n + 1, BASE, "uint64")
        step[0] = 1
        power = np.multiply.accumulate(step)
        step[1:] = INVERSE
        self.back = np.multiply.accumulate(step)
        self.sum = np.zeros(n + 1, "uint64")
        np.cumsum(mix(code + U(0x632BE59BD9B4E019)) * power[:n], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.back[start])


def sliding_argmin(order: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value in each window of ``width``; values that share all but their last bits tie."""
    n, bits = len(order), U(PLACE_BITS)
    if n < 1 << PLACE_BITS:
        best, place = (order >> bits << bits) | np.arange(n, dtype="uint64"), None
    else:  # longer texts: ranks in the same order
        place = np.argsort(order >> bits, kind="stable")
        best = np.empty(n, "uint64")
        best[place] = np.arange(n, dtype="uint64")
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo("uint64").max, "uint64")
    padded[:n] = best
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    s = np.arange(n - width + 1)
    least = np.minimum(after[s], before[s + width - 1])
    return (least & U((1 << PLACE_BITS) - 1)).astype("int64") if place is None else place[least.astype("int64")]


def compact_windows(texts: list[str], span: int, gram: int) -> tuple[Hashed, dict[str, np.ndarray]]:
    """Of each text: (text number, minimum, first and last start of the windows it is minimal in, signature, hash of the whole extent)."""
    h = Hashed(texts)
    width = span - gram + 1
    total = len(h.sum) - 1
    names = ("k", "at", "lo", "hi", "sig", "ctx")
    if total < span:
        return h, {c: np.zeros(0, "uint64" if c in names[4:] else "int64") for c in names}
    s = np.arange(total - gram + 1)
    token = h.of(s, s + gram)
    least = sliding_argmin(token, width)
    owner = np.repeat(np.arange(len(texts)), h.length)[: len(least)]
    inside = np.arange(len(least)) + span <= (h.begin + h.length)[owner]
    start = np.flatnonzero(inside)
    at, k = least[start], owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    at, k, lo, hi = at[first], k[first], start[first], start[last]
    return h, dict(zip(names, (k, at, lo, hi, token[at], h.of(lo, hi + span))))


def _chunks(x: pd.DataFrame, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch with at most about ``most`` characters, so that memory doesn't depend on text lengths."""
    part = (x["t"].str.len().cumsum() // most).to_numpy()
    for _, y in x.groupby(part, sort=False):
        yield y


def shared_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 400) -> DataFrame:
    """(doc_id, start_pos, end_pos): the ranges of each document covered by spans of at least ``span`` characters that also
    stand, verbatim, in a document with another id; overlapping or touching spans form one range.

    Null and short texts have none. Rows that repeat an id with the same text count once; a text that differs under one id
    counts with that id. Offsets are code points.
    """
    gram = max(1, span // 2)
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.col("d").isNotNull() & (F.length("t") >= span))
    kind = dict(src.dtypes)["d"]

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in _chunks(b):
                h, w = compact_windows(x["t"].tolist(), span, gram)
                base = h.begin[w["k"]]
                yield pd.DataFrame({"d": x["d"].to_numpy()[w["k"]], "at": (w["at"] - base).astype("int32"), "lo": (w["lo"] - base).astype("int32"), "hi": (w["hi"] - base).astype("int32"), "sig": w["sig"].view("int64"), "ctx": w["ctx"].view("int64")})

    made = cut(spread(src).mapInPandas(windows, f"d {kind}, at int, lo int, hi int, sig bigint, ctx bigint"))
    node, names = ["sig", "ctx", "left", "more"], ["tag", "sig"]  # a node goes by two hashes
    compact = made.selectExpr("d", "at", "lo", "sig", "ctx", "at - lo AS left", "hi - lo AS more").withColumn("tag", F.xxhash64(*node))
    extent = compact.groupBy(*node).agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min_by("at", "d").alias("at0"))
    extent = cut(extent.withColumn("tag", F.xxhash64(*node)))
    several = extent.groupBy("sig").agg(F.min("d0").alias("a"), F.max("d1").alias("b"), F.count("*").alias("n")).where("a != b and n > 1").select("sig")
    asked = extent.join(several, "sig", "left_semi").groupBy(F.col("d0").alias("d")).agg(F.collect_list(F.struct("tag", "sig", "left", "more", "at0")).alias("w"))  # a text's own windows
    asked = cut(asked)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in _chunks(b):
                h = Hashed(x["t"].tolist())
                rows = [(k, r["tag"], r["sig"], r["left"], r["more"], r["at0"]) for k, w in enumerate(x["w"]) for r in w]
                k, tag, sig, left, more, at = (np.array(c, "int64") for c in zip(*rows))
                count = more + 1
                j = np.repeat(np.arange(len(rows)), count)
                start = (at - left + h.begin[k])[j] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                same = h.of(start, start + span)
                yield pd.DataFrame({"tag": tag, "sig": sig, "same": np.split(same.view("int64"), np.cumsum(count)[:-1])})

    unit = cut(may_contain(src, "d", asked, "d").join(asked, "d").mapInPandas(compared, "tag bigint, sig bigint, same array<bigint>"))
    each = unit.select(*names, F.posexplode("same").alias("o", "same"))
    common = each.groupBy("sig", "same").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a != b").select("sig", "same")
    part = each.join(common, ["sig", "same"], "left_semi").groupBy(*names).agg(F.min("o").alias("o0"), F.max("o").alias("o1"))
    known = extent.where("d0 != d1").select(*names, F.lit(0).alias("o0"), F.col("more").alias("o1")).unionByName(part).groupBy(*names).agg(F.min("o0").alias("o0"), F.max("o1").alias("o1"))
    known = cut(known)
    found = may_contain(compact, "tag", known, "tag").join(known, names).select("d", (F.col("lo") + F.col("o0")).alias("s"), (F.col("lo") + F.col("o1") + span).alias("e"))
    w = Window.partitionBy("d").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") > F.col("reach"), 1).otherwise(0)).over(w)
    return (
        found.distinct().withColumn("reach", reach).withColumn("island", island)
        .groupBy(F.col("d").alias("doc_id"), "island").agg(F.min("s").cast("int").alias("start_pos"), F.max("e").cast("int").alias("end_pos"))
        .select("doc_id", "start_pos", "end_pos")
    )


def shared_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 400) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document with an id: how much of it stands elsewhere too.

    Documents without shared spans, empty ones included, have 0; null texts have null ``n_chars`` and share.
    """
    r = shared_ranges(docs, doc_id, text, span).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.length(text).alias("n_chars")).where("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    return base.join(r, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).when(F.col("n_chars") == 0, 0.0).alias("shared_share"))
