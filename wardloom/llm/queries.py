"""Queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm import encodings, languages, leakage, lookalike, mapping, packing, personal, sentences, spans
from wardloom.session import cut, table


def section_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "section_names")
    return t.select(F.col("canonical_name").alias("entry"), F.explode(F.concat(F.array("canonical_name", "title"), F.coalesce("aliases", F.array()))).alias("name"))


def concept_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "canonical_concepts")
    names = F.concat(F.array("canonical_name"), F.coalesce("preferred_terms", F.array()), F.coalesce("synonyms", F.array()))
    return t.select(F.col("concept_id").alias("entry"), F.explode(names).alias("name"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections, listed = table(spark, sf_dir, "detected_sections"), table(spark, sf_dir, "section_names").select("canonical_name").distinct()
    asked = sections.join(listed, "canonical_name", "left_anti")
    a = mapping.mapped(asked, "section_id", "original_heading", section_entries(spark, sf_dir))
    b = mapping.mapped(table(spark, sf_dir, "clinical_terms"), "term_id", "term", concept_entries(spark, sf_dir), also="aliases")
    out = lambda x, name, key: x.select(F.lit(name).alias("src_table"), F.col(key).cast("bigint").alias("row_id"), "canonical")
    return out(a, "detected_sections", "section_id").unionByName(out(b, "clinical_terms", "term_id"))


def _mended_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text requests in the form they were written in, with the stored offset of each sign."""
    src = table(spark, sf_dir, "text_requests").select(F.lit("text_requests").alias("src_table"), "request_id", "source", "text")
    return cut(encodings.repaired(src, ["src_table", "request_id"]).select("request_id", "text", "at"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(_mended_requests(spark, sf_dir), "request_id", at="at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lookalike.same_look_pairs(table(spark, sf_dir, "documents"), "doc_id").select(F.lit("documents").alias("src_table"), "id_a", "id_b")
    deid = lookalike.same_look_pairs(table(spark, sf_dir, "deid_requests"), "request_id").select(F.lit("deid_requests").alias("src_table"), "id_a", "id_b")
    return docs.unionByName(deid)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name: table(spark, sf_dir, name).select(F.lit(name).alias("src_table"), "request_id", "source", "text")
    return one("text_requests").unionByName(one("deid_requests"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.found(_requests(spark, sf_dir), ["src_table", "request_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = languages.trained(docs)
    told = cut(languages.document_languages(docs, net).where("language is not null").groupBy("doc_id").agg(F.max_by("language", "confidence").alias("language")))

    def wrong(df: DataFrame, name: str, key: str, label: str) -> DataFrame:
        rows = df.select(F.col(key).cast("string").alias("record_key"), "doc_id", languages.code(F.col(label)).alias("had")).distinct().join(told, "doc_id")
        return rows.where(~F.col("had").eqNullSafe(F.col("language"))).select(F.lit(name).alias("src_table"), "record_key", F.lit(0).alias("start_pos"), "language").distinct()

    results, matrix = table(spark, sf_dir, "understanding_results"), table(spark, sf_dir, "test_matrix")
    out = wrong(docs, "documents", "doc_id", "lang").unionByName(wrong(results, "understanding_results", "result_id", "language")).unionByName(wrong(matrix, "test_matrix", "case_id", "language"))
    mended = _mended_requests(spark, sf_dir)
    units = sentences.texts_of_units(mended, "request_id", at="at")
    parts = languages.segments(units, net).select(F.lit("text_requests").alias("src_table"), F.col("request_id").cast("string").alias("record_key"), "start_pos", "language")
    return out.unionByName(parts)


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "deid_requests").select(F.lit("deid_requests").alias("src_table"), F.col("request_id").alias("row_id"), "source", "text")
    mended = encodings.repaired(src, ["src_table", "row_id"]).select("src_table", "row_id", "text", "at")
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("row_id"), "text", F.lit(None).cast("array<int>").alias("at"))
    return personal.personal_spans(cut(mended).unionByName(docs), ["src_table", "row_id"], at="at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).distinct()


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "deid_requests").select(F.lit("deid_requests").alias("src_table"), F.col("request_id").alias("row_id"), "text").distinct()
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("row_id"), "text")
    return personal.masked(rows.unionByName(docs), cut(_personal(spark, sf_dir)), ["src_table", "row_id"]).drop("text")


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), max_segments=32, max_loss=2000)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_ranges(table(spark, sf_dir, "documents"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_report(table(spark, sf_dir, "documents"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and request that looks like one with another stored text, with its class: linear in the rows, however many look the same."""
    one = lambda name, key: lookalike.classes(table(spark, sf_dir, name), key).select(F.lit(name).alias("src_table"), "id", "look", "stored")
    return one("documents", "doc_id").unionByName(one("deid_requests", "request_id"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_classes, p4_found, p5_found, p6_found, p6_masked, p7_packs, p8_found, p9_found, p9_shared)}
_WINDOWS = """starts AS (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 400)),
    windows AS (SELECT doc_id, i, substr(text, i, 400) AS w FROM starts), common AS (SELECT w FROM windows GROUP BY w HAVING min(doc_id) <> max(doc_id)),
    hits AS (SELECT DISTINCT doc_id, i FROM windows SEMI JOIN common USING (w)),
    marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM hits),
    ranges AS (SELECT doc_id, CAST(min(i) - 1 AS INT) AS start_pos, CAST(max(i) + 399 AS INT) AS end_pos FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked) GROUP BY doc_id, island)"""
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
SQL: dict[str, str] = {
    "p8_found": f"""WITH items AS (SELECT item_id, w, CAST(ceil(len(w) / 2.0) AS INT) AS need FROM (SELECT DISTINCT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
        runs AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[i:i+need-1], ' ') || ' ' AS run FROM (SELECT *, unnest(range(1, len(w) - need + 2)) AS i FROM items)),
        docs AS (SELECT DISTINCT doc_id, ' ' || array_to_string({_WORDS.format("text")}, ' ') || ' ' AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
        SELECT DISTINCT doc_id, item_id FROM docs JOIN runs ON contains(t, run)""",
    "p9_found": f"WITH {_WINDOWS} SELECT doc_id, start_pos, end_pos FROM ranges",
    "p9_shared": f"""WITH {_WINDOWS}, n AS (SELECT doc_id, CAST(max(length(text)) AS INT) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id), s AS (SELECT doc_id, sum(end_pos - start_pos) AS shared FROM ranges GROUP BY doc_id)
        SELECT doc_id, n_chars, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars, CAST(CASE WHEN n_chars > 0 THEN coalesce(shared, 0) / n_chars WHEN n_chars = 0 THEN 0 END AS DOUBLE) AS shared_share FROM n LEFT JOIN s USING (doc_id)""",
}
