"""One consistent form for text that looks the same but differs in its characters (problem 3).

What doesn't change the look: invisible characters; width and kind of a blank or hyphen; full-width, joined and
presentation forms; the way an accent is encoded; the alphabet that a same-looking letter is taken from. Case, digits, digit
scripts, accents, raised figures and line breaks stay.

Texts without any such character, nor marks that could be out of order, are in that form already and are only tested for it.
The others are exploded to positioned units (a run of plain ASCII, or one character with its marks). The distinct units are
exploded to code points, broadcast-joined with the decomposition and look-alike table, their marks ordered by combining
class, and recomposed; then the texts are rebuilt from their units.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardloom.session import cut

# Letters of other alphabets whose look is that of a Latin letter, and the Latin letter.
LOOKS = (
    # Cyrillic
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl "
    # Greek
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC Ϳ J αa ιi νv οo ρp υu ϲc ϳj "
    # Armenian and Latin letters of phonetic alphabets
    "օo սu հh ցg ɡg ɑa"
)
# Kinds of hyphen.
HYPHENS = "‐‑﹣－"
#: Decomposition tags that keep the look. Raised, lowered, circled, squared, fraction and font variants look different.
KEEPING = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def _invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" and not "؀" <= c <= "؅" and c not in "۝܏࣢" or "︀" <= c <= "️" or c in "͏ᅟᅠㅤﾠ"


def _target(c: str) -> str | None:
    """What a single character turns into before marks are ordered, or None if it stays."""
    if _invisible(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if c in HYPHENS:
        return "-"
    tag = unicodedata.decomposition(c)
    if not tag:
        return None
    if tag[0] != "<":
        return unicodedata.normalize("NFD", c)
    kind, _, rest = tag.partition(" ")
    if kind in KEEPING or kind == "<compat>" and unicodedata.category(c)[0] == "L":
        return "".join(x if (t := _target(x)) is None else t for x in (chr(int(p, 16)) for p in rest.split()))
    return None


@lru_cache(maxsize=1)
def character_table() -> dict[str, str]:
    """Character to its decomposed, same-looking form; only characters that change."""
    table = {c: t for c in map(chr, [*range(0x20, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]) if not "가" <= c <= "힣" and (t := _target(c)) is not None and t != c}
    looks = {p[0]: p[-1] for p in LOOKS.replace(" J ", "J ").split()}
    for c, t in table.items():
        table[c] = "".join(looks.get(x, x) for x in t)
    return looks | table


@lru_cache(maxsize=1)
def telling_characters() -> str:
    """Characters whose presence means that a text may not be in the consistent form."""
    own = {c for c, t in character_table().items() if unicodedata.normalize("NFC", t) != c}
    second = {d[-1] for c in map(chr, range(0xC0, 0x11000)) if (d := unicodedata.normalize("NFD", c)) != c and len(d) > 1 and unicodedata.normalize("NFC", d) == c and not "가" <= c <= "힣"}
    jamo = set(map(chr, range(0x1161, 0x1200)))
    return "".join(sorted(own | second | jamo | set("یک")))


#: Joined letters of the Arabic script before which yeh and kaf have their inner forms.
INNER = r"(?=\p{M}*[ؠ-يٮ-ۓ])"
UNIT = r"(?s)(?:[\x09\x0a\x20-\x7e](?!\p{M}))+|[ᄀ-ᅟ][ᅠ-ᆧ][ᆨ-ᇿ]?|.\p{M}*"
PLAIN = r"^[\x09\x0a\x20-\x7e]+$"


def needs_work(text: Column) -> Column:
    return (F.translate(text, telling_characters(), "") != text) | text.rlike(r"\p{M}{2}")


def unit_forms(units: DataFrame) -> DataFrame:
    """(unit, form) of distinct units."""
    spark = units.sparkSession
    table = F.broadcast(_table(spark))  # fixed by the Unicode version
    classes = F.broadcast(_classes(spark))
    points = units.select("unit", F.posexplode(F.split("unit", "")).alias("pos", "ch")).join(table, "ch", "left")
    points = points.select("unit", "pos", F.posexplode(F.split(F.coalesce("to", "ch"), "")).alias("sub", "ch")).where("ch != ''").join(classes, "ch", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    w = Window.partitionBy("unit").orderBy("pos", "sub")
    points = points.withColumn("starter", F.sum((F.col("ccc") == 0).cast("int")).over(w))
    built = points.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("starter", "ccc", "pos", "sub", "ch"))).alias("p")).select("unit", F.array_join(F.transform("p", lambda x: x["ch"]), "").alias("ordered"))

    @F.pandas_udf("string")
    def recompose(s: pd.Series) -> pd.Series:  # Spark has no composition; this sees distinct units only
        return s.map(lambda x: unicodedata.normalize("NFC", x))

    return units.join(built.select("unit", recompose("ordered").alias("form")), "unit", "left").select("unit", F.coalesce("form", F.lit("")).alias("form"))


def _table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(list(character_table().items()), columns=["ch", "to"]), "ch string, to string")


def _classes(spark: SparkSession) -> DataFrame:
    rows = [(c, k) for c in map(chr, [*range(0x300, 0xD800), *range(0xF900, 0x20000)]) if (k := unicodedata.combining(c))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["ch", "ccc"]), "ch string, ccc int")


def consistent(df: DataFrame, keys: list[str], text: str = "text", broadcast_units: int = 200_000) -> DataFrame:
    """``keys`` and ``form``, the text in its consistent form; one row for each input row whose keys aren't all null.

    A null text has a null form, an empty or wholly invisible one an empty form. Rows that repeat their keys are one row;
    if their texts differ, each is. Other columns don't matter.
    """
    src = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))
    ks = [f"k{i}" for i in range(len(keys))]
    src = src.where(~F.coalesce(needs_work(F.col("t")), F.lit(False))).select(*ks, F.col("t").alias("form")), src.where(needs_work(F.col("t")))
    done, todo = src
    yeh = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", "ی" + INNER, "ي"), "ی", "ى"), "ک" + INNER, "ك")
    units = cut(todo.withColumn("h", F.xxhash64("t")).dropDuplicates([*ks, "h"]).select(*ks, "h", F.posexplode(F.regexp_extract_all(yeh, F.lit(UNIT), F.lit(0))).alias("pos", "unit")))
    odd = units.where(~F.col("unit").rlike(PLAIN))
    forms = cut(unit_forms(odd.select("unit").distinct()))
    few = forms.count() <= broadcast_units
    joined = odd.join(F.broadcast(forms) if few else forms, "unit")
    pieces = units.where(F.col("unit").rlike(PLAIN)).select(*ks, "h", "pos", F.col("unit").alias("form")).unionByName(joined.select(*ks, "h", "pos", "form"))
    rebuilt = pieces.groupBy(*ks, "h").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("p")).select(*ks, F.array_join(F.transform("p", lambda x: x["form"]), "").alias("form"))
    out = done.unionByName(rebuilt)
    return out.select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], "form")


def classes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, look, stored): a document's class of equal look and its class of equal storage within it, by hash.

    Only documents whose look has at least two stored texts come out.
    """
    src = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null").withColumn("stored", F.sha2("t", 256))
    form = consistent(src, ["id", "stored"], "t").select("id", "stored", F.sha2("form", 256).alias("look"))
    form = cut(form)
    varied = form.groupBy("look").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a != b").select("look")
    return form.join(varied, "look", "left_semi").select("id", "look", "stored").distinct()


def same_look_pairs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id_a, id_b), smaller first: rows whose texts differ as stored but look the same.

    Null ids and texts are in no pair. Pairs are all pairs of different stored texts in a class, as the result demands;
    texts equal as stored never meet.
    """
    c = cut(classes(df, key, text))
    a, b = c.select("look", F.col("id").alias("id_a"), F.col("stored").alias("sa")), c.select("look", F.col("id").alias("id_b"), F.col("stored").alias("sb"))
    return a.join(b, "look").where("sa != sb and id_a < id_b").select("id_a", "id_b").distinct()
