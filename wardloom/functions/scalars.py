"""Scalar expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often it is used: a lambda's argument is a variable, a column is a copy."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Arabic-Indic and Persian digits.
OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


def digits_folded(value: Column) -> Column:
    return F.translate(value, OTHER_DIGITS, "0123456789" * 2)


def stable_hash(value: Column, n: int = 10) -> Column:
    """The first ``n`` hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, n)


def masked(value: Column) -> Column:
    """Stars, but for the first and last two signs of a value of more than four."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(value, n - 1, F.lit(2))))


def transformed(value: Column, kind: Column, action: Column, hash_length: int = 10) -> Column:
    """What stands for ``value`` of type ``kind`` under a policy's ``action``; an unknown action keeps it."""
    tag = F.upper(kind)
    return (
        F.when(action == "replace", F.concat(F.lit("["), tag, F.lit("]")))
        .when(action == "hash", F.concat(F.lit("["), tag, F.lit(":"), stable_hash(value, hash_length), F.lit("]")))
        .when(action == "mask", masked(value))
        .when(action == "remove", F.lit("[REMOVED]"))
        .otherwise(value)
    )


def heading_key(value: Column) -> Column:
    """Small letters, anything but letters, digits and underscores as one blank."""
    return F.trim(F.regexp_replace(F.lower(value), r"(?U)[^\w]+", " "))


def label_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), "[^a-zA-Z0-9]+", "_")


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)))


def line_count(text: Column) -> Column:
    """Lines of a text, a trailing line break not counted; 0 for an empty text."""
    body = F.regexp_replace(text, r"(?:\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ])$", "")
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(body, r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]")))


def extension(path: Column) -> Column:
    """The ending of a file path with its dot, in small letters; empty if there is none or it holds a blank."""
    return F.lower(F.regexp_extract(F.trim(path), r"(\.[^./\\\s]+)$", 1))


def letters(text: Column, ranges: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{ranges}]", ""))


#: Signs that end a line.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85\\u2028\\u2029]"


def text_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def lookup(values: dict, column: Column, default: object) -> Column:
    """The value of a small table of fixed values."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[column], F.lit(default))


def blank(text: Column) -> Column:
    """Whether nothing but blanks and line breaks stands in a text; null for null."""
    return ~text.rlike(r"[^\s   -     　\x1c-\x1f\x85]")


def with_worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once for each row: they pass a generator, through which the optimiser moves no copies of them."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))  # outer, since else a filter would work them out too
