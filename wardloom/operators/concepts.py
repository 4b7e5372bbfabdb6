"""The concept model: merge, coverage, resolution of terms in text, version differences and integrity.

A concept has ``concept_id``, ``canonical_name``, ``concept_family``, ``domain``, ``preferred_terms``, ``synonyms``, ``languages`` and ``status``; imported
ones also ``mappings`` (source_id, external_id, display, mapping_type), ``relationships`` (type, target, sources, source_relationship,
sequence_order, external_id), ``provenance`` and ``attributes``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.session import cut

MAPPING = "struct<source_id:string,external_id:string,display:string,mapping_type:string>"
RELATIONSHIP = "struct<type:string,target:string,sources:array<string>,source_relationship:string,sequence_order:string,external_id:string>"
CONCEPT = (
    "concept_id string, canonical_name string, concept_family string, domain string, preferred_terms array<string>, synonyms array<string>, languages array<string>, "
    f"mappings array<{MAPPING}>, relationships array<{RELATIONSHIP}>, provenance array<string>, status string, attributes map<string,string>"
)
#: Longest term that is looked for in texts, in words.
WIDEST = 10


@lru_cache(maxsize=1)
def compatible_signs() -> tuple[str, str]:
    """Signs of the basic plane that compatibility composition (NFKC) turns into one other sign, and those signs."""
    pairs = [(c, n) for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c]
    return "".join(c for c, _ in pairs), "".join(n for _, n in pairs)


#: Joined letters that compatibility composition takes apart, and letters that case folding does.
TAKEN_APART = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ß": "ss", "ẞ": "ss"}


def folded(value: Column) -> Column:
    """Compatible signs made one, and small letters.

    Done in the JVM: signs that NFKC turns into several others, but for joined Latin letters, and marks that it joins with
    the letter before them stay as they are.
    """
    out = F.translate(value, *compatible_signs())
    for a, b in TAKEN_APART.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(F.lower(out), "ς", "σ")


WORD = r"[\p{L}\p{M}\p{N}_؀-ۿ]+"
GAP = r"[^\p{L}\p{M}\p{N}_؀-ۿ]+"


def term_key(value: Column) -> Column:
    """The form in which terms are compared: folded words with single blanks, other signs dropped."""
    return F.trim(F.regexp_replace(folded(value), GAP, " "))


def merged(concepts: DataFrame, order: Sequence[str] = ("concept_id",)) -> DataFrame:
    """One row for each domain, family and name: id, name and status of the first row by ``order``, the distinct terms of all rows in order."""
    row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], "concept_id", "canonical_name", "status", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("preferred_terms", "synonyms", "languages")])
    key = [F.lower("domain").alias("domain"), F.lower("concept_family").alias("concept_family"), term_key(F.col("canonical_name")).alias("name")]
    rows = concepts.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("r"))  # the sources of one concept
    together = lambda c: F.array_distinct(F.flatten(F.transform("r", lambda x: x[c])))
    first = F.col("r")[0]
    return rows.select("domain", "concept_family", "name", *[first[c].alias(c) for c in ("concept_id", "canonical_name", "status")], *[together(c).alias(c) for c in ("preferred_terms", "synonyms", "languages")])


def merged_full(concepts: DataFrame) -> DataFrame:
    """As ``merged`` for imported concepts: mappings, relationships, provenance and attributes of all rows are kept. Targets that named a row which isn't first stay; ``crosswalk`` has their new ids."""
    row = F.struct("concept_id", "canonical_name", "status", "preferred_terms", "synonyms", "languages", "mappings", "relationships", "provenance", F.map_entries("attributes").alias("attributes"))
    rows = concepts.groupBy("domain", "concept_family", term_key(F.col("canonical_name")).alias("_name")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    together = lambda c: F.array_distinct(F.flatten(F.transform("r", lambda x: x[c])))
    first = F.col("r")[0]
    attributes = F.aggregate(F.flatten(F.transform("r", lambda x: x["attributes"])), F.array().cast("array<struct<key:string,value:string>>"), lambda a, x: F.when(F.exists(a, lambda y: y["key"] == x["key"]), a).otherwise(F.concat(a, F.array(x))))
    return rows.select(
        first["concept_id"].alias("concept_id"), first["canonical_name"].alias("canonical_name"), "concept_family", "domain", together("preferred_terms").alias("preferred_terms"), together("synonyms").alias("synonyms"),
        together("languages").alias("languages"), together("mappings").alias("mappings"), together("relationships").alias("relationships"), together("provenance").alias("provenance"), first["status"].alias("status"),
        F.map_from_entries(attributes).alias("attributes"),
    )


def crosswalk(concepts: DataFrame) -> DataFrame:
    """(concept_id, kept_id) of the concepts that a merge drops."""
    key = ["domain", "concept_family", term_key(F.col("canonical_name"))]
    ids = concepts.groupBy(*key).agg(F.min("concept_id").alias("kept_id"), F.collect_set("concept_id").alias("ids")).select("kept_id", F.explode("ids").alias("concept_id"))
    return ids.where("concept_id != kept_id").select("concept_id", "kept_id")


def terms_of(concepts: DataFrame) -> DataFrame:
    """(concept_id, term): every name, preferred term and synonym in its compared form."""
    names = F.concat(F.array("canonical_name"), F.coalesce("preferred_terms", F.array()), F.coalesce("synonyms", F.array()))
    return concepts.select("concept_id", F.explode(names).alias("t")).select("concept_id", term_key(F.col("t")).alias("term")).where("term != ''").distinct()


def resolved_terms(asked: DataFrame, terms: DataFrame, column: str = "term") -> DataFrame:
    """``asked`` with the concepts that each of its values is a term of; values of none have null."""
    form = asked.withColumn("_form", term_key(F.col(column)))
    return form.join(terms.select("concept_id", F.col("term").alias("_form")), "_form", "left").drop("_form")


def resolved(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", widest: int | None = None, small: int = 200_000) -> DataFrame:
    """(key, concept_id, term, start_pos, end_pos, found): where each term stands in each text; nested spans are all kept.

    The words of a text meet the first words of the terms, then the runs that begin there and are as long as one of those
    terms meet the terms. Up to ``small`` terms both go to the executors; beyond that runs are made before they are joined,
    so that no row of a shuffle holds more than one run. Terms may have ``widest`` words, by default as many as the longest, up to 10.
    """
    listed = terms.select("concept_id", "term", F.size(F.split("term", " ")).alias("n")).where("term != ''")
    size = listed.agg(F.count("*").alias("rows"), F.max("n").alias("n")).first()
    most = min(widest or WIDEST, size.n or 1)
    listed = listed.where(F.col("n") <= most)
    src = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    src = src.select("k", words.alias("w"), F.transform(F.split("t", WORD), lambda g: F.length(g)).alias("g"))
    src = src.withColumn("f", F.transform("w", term_key)).where(F.size("w") > 0)
    at = lambda i: F.aggregate(F.slice("g", 1, i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice("w", 1, i), F.lit(0), lambda a, x: a + F.length(x))
    run = lambda c, i, n: F.array_join(F.slice(c, i + 1, n), " ")
    ends = lambda i, n: at(i + n - 1) + F.length(F.get(F.col("w"), i + n - 1))
    lead = listed.select(F.split("term", " ")[0].alias("first"), "n").groupBy("first").agg(F.collect_set("n").alias("widths"))  # at most WIDEST widths
    if size.rows <= small:
        hit = src.select("*", F.posexplode("f").alias("i", "first")).join(F.broadcast(lead), "first").select("*", F.explode("widths").alias("n")).where(F.col("i") + F.col("n") <= F.size("w"))
        spans = hit.withColumn("term", run("f", F.col("i"), F.col("n"))).join(F.broadcast(listed.drop("n")), "term")
        start, end = at(F.col("i")), ends(F.col("i"), F.col("n"))
        return spans.select(F.col("k").alias(key), "concept_id", "term", start.cast("int").alias("start_pos"), end.cast("int").alias("end_pos"), run("w", F.col("i"), F.col("n")).alias("found"))
    indexes = F.sequence(F.lit(0), F.size("w") - 1)
    runs = F.flatten(F.transform(indexes, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - i)), lambda n: F.struct(i.alias("i"), n.alias("n"), run("f", i, n).alias("term"), run("w", i, n).alias("found"), at(i).alias("s"), ends(i, n).alias("e")))))
    each = src.select("k", F.inline(runs))
    return each.join(listed.drop("n"), "term").select(F.col("k").alias(key), "concept_id", "term", F.col("s").cast("int").alias("start_pos"), F.col("e").cast("int").alias("end_pos"), "found")


def resolved_counts(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, concept_id, term, n): how often each term stands in each text."""
    return resolved(docs, terms, key, text).groupBy(key, "concept_id", "term").agg(F.count("*").alias("n"))


def best_spans(found: DataFrame, key: str = "doc_id", most: int = 8, least_signs: int = 3) -> DataFrame:
    """Spans with at most ``most`` of their concepts, the first by id, and terms of at least ``least_signs`` signs."""
    spans = found.where(F.length("term") >= least_signs).groupBy(key, "start_pos", "end_pos", "term").agg(F.array_sort(F.collect_set("concept_id")).alias("ids"))
    return spans.select(key, "start_pos", "end_pos", "term", F.explode(F.slice("ids", 1, most)).alias("concept_id"))


def coverage(concepts: DataFrame) -> DataFrame:
    """(facet, value, n) counts of domains, families, states and languages."""
    facet = lambda name, c: concepts.select(F.lit(name).alias("facet"), c.alias("value"))
    parts = [facet("domain", F.col("domain")), facet("family", F.col("concept_family")), facet("status", F.col("status")), facet("language", F.explode("languages"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("facet", "value").agg(F.count("*").alias("n"))


def differences(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed between two versions."""
    a, b = old.select(F.col(key).alias("k"), F.col(value).alias("a"), F.lit(True).alias("in_old")), new.select(F.col(key).alias("k"), F.col(value).alias("b"), F.lit(True).alias("in_new"))
    j = a.join(b, "k", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select(F.col("k").alias(key), change.alias("change")).where("change is not null")


def orphans(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """(value, n): values of ``column`` that aren't in the list of known ones."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("value is not null")  # before the join: one row a value
    return counts.join(known.select(F.col(known_column).alias("value")).distinct(), "value", "left_anti")


def coverage_report(concepts: DataFrame) -> DataFrame:
    """(facet, value, n) of imported concepts: totals, and counts by source, family, kind of record, mapping source and kind of relationship."""
    kind = F.coalesce(F.col("attributes")["record_type"], F.lit("UNCLASSIFIED"))
    part = lambda name, c: concepts.select(F.lit(name).alias("facet"), c.alias("value"))
    facets = [
        part("source", F.explode("provenance")), part("family", F.col("concept_family")), part("record_type", kind), part("mapping_source", F.explode("mappings.source_id")),
        part("relationship", F.explode("relationships.type")),
    ]
    counts = facets[0]
    for p in facets[1:]:
        counts = counts.unionByName(p)
    totals = concepts.agg(
        F.count("*").alias("concepts"), F.sum(F.size("preferred_terms")).alias("preferred_terms"), F.sum(F.size("synonyms")).alias("synonyms"), F.sum(F.size("mappings")).alias("mappings"),
        F.sum(F.size("relationships")).alias("relationships"), F.count_distinct(F.col("attributes")["cid"]).alias("context_groups"),
    )
    flat = totals.select(F.inline(F.array(*[F.struct(F.lit("total").alias("facet"), F.lit(c).alias("value"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n")) for c in totals.columns])))
    return counts.groupBy("facet", "value").agg(F.count("*").alias("n")).unionByName(flat)


def support(concepts: DataFrame, own: str) -> DataFrame:
    """(support, n): how the concepts of the source ``own`` are backed: by mappings, by a second source, or by nothing else."""
    backed = F.when(F.size("mappings") > 0, "reference_backed").when(F.size("provenance") > 1, "redundant").otherwise("compatibility_only")
    return concepts.where(F.array_contains("provenance", own)).groupBy(backed.alias("support")).agg(F.count("*").alias("n"))


def integrity(concepts: DataFrame, sources: DataFrame) -> DataFrame:
    """(problem, value, n): ids given twice, and sources of provenance or mappings that aren't in ``sources`` (``source_id``). Empty for a sound model."""
    twice = concepts.groupBy(F.col("concept_id").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate id").alias("problem"), "value", "n")
    unknown = lambda c, what: orphans(concepts.select(F.explode(c).alias("value")), "value", sources, "source_id").select(F.lit(what).alias("problem"), "value", "n")
    return twice.unionByName(unknown("provenance", "unknown source")).unionByName(unknown("mappings.source_id", "unknown mapping source"))


def edges_of(concepts: DataFrame, kind: str | None = None) -> DataFrame:
    """(child, parent, type) of the relationships of concepts, of one kind or all."""
    e = concepts.select(F.col("concept_id").alias("child"), F.explode("relationships").alias("r")).select("child", F.col("r.target").alias("parent"), F.col("r.type").alias("type"))
    return e if kind is None else e.where(F.col("type") == kind)


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent", deepest: int = 30) -> DataFrame:
    """(child, ancestor, depth): all ancestors by the shortest way, up to ``deepest`` steps; cycles end where they close.

    Each round joins only what the last one found; what is known stays in the files of its own round.
    """
    step = cut(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child != ancestor").distinct())
    up = step.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("up"))
    known = new = step.withColumn("depth", F.lit(1))
    for depth in range(2, deepest + 1):
        more = new.join(up, "ancestor").select("child", F.col("up").alias("ancestor")).where("child != ancestor").distinct()
        new = cut(more.join(known, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known
