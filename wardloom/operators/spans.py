"""Spans of regular expressions as rows, without a Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.scalars import bound


SPANS = "array<struct<start_pos:int,end_pos:int,value:string,lead:string>>"


def located(text: Column, pattern: str | Column, lead: int = 0, value: int = 0) -> Column:
    """array<struct<start_pos, end_pos, value, lead>> of all matches of ``pattern``; empty if there are none.

    ``value`` is the group that the span is, ``lead`` the group that stands before it in the match (0: the match begins
    with the value). Groups must be adjacent. Offsets count code points. Texts without a match are only searched once.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    groups = {"m": 0, "l": lead, "v": value}
    every = {n: F.regexp_extract_all(text, p, F.lit(g)) for n, g in groups.items() if n == "m" or g}
    rows = F.arrays_zip(F.split(text, p, -1).alias("b"), *[c.alias(n) for n, c in every.items()])  # what stands before the first, then each match; the last has none
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        ahead = x["l"] if lead else F.lit("")
        start = a["at"] + F.length(x["b"]) + F.length(ahead)
        own = x["v"] if value else x["m"]
        span = F.struct(start.alias("start_pos"), (start + F.length(own)).alias("end_pos"), own.alias("value"), ahead.alias("lead"))
        return F.when(x["m"].isNull(), a).otherwise(F.struct((a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    return F.when(F.regexp_like(text, p), F.aggregate(rows, zero, step, lambda a: a["out"])).otherwise(F.array().cast(SPANS))


def extracted(df: DataFrame, keys: list[str], text: str, rules: list[tuple[str, str, str, str, int, int]]) -> DataFrame:
    """One row for each match of each rule (name, type, source, pattern, lead, value): keys, seq, rule, kind, source, start_pos, end_pos, value.

    Null texts have none. ``seq`` is the rule's number, which settles ties.
    """
    def tagged(seq: int, rule: tuple[str, str, str, str, int, int]) -> Column:
        name, kind, source, pattern, lead, value = rule
        tags = [F.lit(seq).alias("seq"), F.lit(name).alias("rule"), F.lit(kind).alias("kind"), F.lit(source).alias("source")]
        return F.transform(located(F.col(text), pattern, lead, value), lambda x: F.struct(*tags, x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), x["value"].alias("value")))

    each = [tagged(i, r) for i, r in enumerate(rules)]
    return df.where(F.col(text).isNotNull()).select(*keys, F.inline(F.concat(*each)))


def greedy(spans: Column) -> Column:
    """The spans of an array kept in its order unless they overlap one kept before, sorted by start; each has start_pos and end_pos."""
    kept = bound(spans, lambda s: F.aggregate(s, F.slice(s, 1, 0), lambda a, x: F.when(F.exists(a, lambda y: (x["start_pos"] < y["end_pos"]) & (x["end_pos"] > y["start_pos"])), a).otherwise(F.concat(a, F.array(x)))))
    return F.array_sort(kept, lambda p, q: F.when(p["start_pos"] < q["start_pos"], -1).when(p["start_pos"] > q["start_pos"], 1).otherwise(0))


def rewritten(text: Column, spans: Column) -> Column:
    """``text`` with each span, in order and without overlaps, replaced by its ``replacement``."""
    zero = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, x["start_pos"] - a["at"]), x["replacement"]).alias("done"), x["end_pos"].alias("at"))
    return F.aggregate(spans, zero, step, lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.length(text))))
