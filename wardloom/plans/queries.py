"""Queries of the core over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions import scalars
from wardloom.operators import candidates, concepts, spans, terms
from wardloom.plans import cases, protect, understand
from wardloom.session import spread, table


def _deid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "deid_requests").select("request_id", "text").distinct()


def _for_sql(pattern: str) -> str:
    """A pattern without the flags that only Java knows: its own line ends and letters of all scripts in any case are the other engine's way."""
    return pattern.replace("(?imdu)", "(?im)").replace("(?imd)", "(?im)").replace("(?iu)", "(?i)").replace("'", "''")


def _spans_sql(pattern: str, source: str, key: str, lead: int = 0, value: int = 0, extra: str = "") -> str:
    """All matches of a pattern with their offsets, in SQL."""
    p = _for_sql(pattern)
    return f"""
    SELECT {key}, {extra} CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + {f"length(l[i])" if lead else "0"} AS INT) AS start_pos, v[i] AS value
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT {key}, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {lead}) AS l, regexp_extract_all(text, '{p}', {value}) AS v, string_split_regex(text, '{p}') AS b FROM {source}))"""


def _rule_query(rule: tuple, name: str, tables: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = table(spark, sf_dir, "documents").select("doc_id", "text") if tables else _deid(spark, sf_dir)
        key = "doc_id" if tables else "request_id"
        return spans.extracted(src, [key], "text", [rule]).select(key, "start_pos", "value")

    run.__name__ = name
    return run


DISTINCT = "(SELECT DISTINCT request_id, text FROM deid_requests)"


def field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.extracted(_deid(spark, sf_dir), ["request_id"], "text", protect.FIELD_RULES).select("request_id", "rule", "kind", "start_pos", "end_pos", "value")


def _field_sql(rules: list) -> str:
    parts = [f"SELECT request_id, '{n}' AS rule, '{k}' AS kind, start_pos, start_pos + length(value) AS end_pos, value FROM ({_spans_sql(p, DISTINCT, 'request_id', lead, value)})" for n, k, _, p, lead, value in rules]
    return " UNION ALL ".join(parts)


def context_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.extracted(_deid(spark, sf_dir), ["request_id"], "text", protect.CONTEXT_RULES).select("request_id", "rule", "kind", "start_pos", "end_pos", "value")


def terms_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is masked by the library's terms and words, and that the masked text is given back whole."""
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text"), terms.protected_by_section(F.col("text")).alias("p"))
    return t.select("doc_id", F.size("p.tokens").alias("n"), F.length("p.text").alias("chars"), (terms.restored(F.col("p.text"), F.col("p.tokens")) == F.col("text")).alias("whole"))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every enabled term of the sites' vocabulary, under any of its names, counted in every document."""
    listed = table(spark, sf_dir, "clinical_terms").dropDuplicates(["term_id"])
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return terms.term_counts(docs, terms.normalised(listed)).groupBy("doc_id", "term").agg(F.sum("n").alias("n"))


def detected_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protect.detected(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])
    return found.groupBy("kind", "source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(protect.policy_rows(), "profile string, kind string, action string").groupBy("profile", "action").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))


_POLICY_VALUES = ", ".join(f"('{p}', '{t}', '{a}')" for p, t, a in protect.policy_rows())


def _deidentify(profile: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return protect.deidentified(_deid(spark, sf_dir), ["request_id"], profile).withColumn("warnings", F.size("warnings"))

    run.__name__ = f"deidentify_{profile}"
    return run


def masked_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every e-mail under every action."""
    found = spans.extracted(_deid(spark, sf_dir), ["request_id"], "text", [protect.EMAIL_RULE])
    value, kind = F.col("value"), F.col("kind")
    made = [scalars.transformed(value, kind, F.lit(a)).alias(a) for a in ("keep", "replace", "hash", "mask", "remove")]
    return found.select("request_id", "start_pos", *made)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.extracted(_deid(spark, sf_dir), ["request_id"], "text", protect.FIELD_RULES)
    return found.withColumn("decision", candidates.identifier_decision(F.col("kind"), F.col("value"))).groupBy("kind", "decision").agg(F.count("*").alias("n"))


def digits_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _deid(spark, sf_dir)
    return t.select("request_id", scalars.digits_folded(F.col("text")).alias("folded")).where("folded is not null")


def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").where(t.isNotNull()).select("doc_id", F.length(t).alias("chars"), scalars.blank(t).alias("is_empty"), scalars.stable_hash(t).alias("digest"))


def file_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "test_matrix").distinct()
    return t.groupBy(scalars.extension(F.coalesce("file_path", F.lit(""))).alias("extension")).agg(F.count("*").alias("n"))


def script_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", understand.script_language(F.col("text")).alias("language"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "section_names")
    return t.select("canonical_name", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array()))).alias("alias"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understand.line_sections(table(spark, sf_dir, "documents"), _names(spark, sf_dir))


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))
    return t.select("doc_id", F.inline(understand.sections_of(F.col("text"))))


def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understand.profile_scores(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understand.classified(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def document_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = understand.contexts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    one = lambda c: F.to_json(F.col(c)).alias(c)
    return made.select("doc_id", "language", one("classification"), one("route"), one("clinical"), one("sections"), one("privacy"), "file_size", "content_id")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "understanding_results").dropDuplicates(["result_id"])
    return t.groupBy(understand.route(F.col("domain"), F.col("confidence_band")).alias("route")).agg(F.count("*").alias("n"))


def concepts_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = concepts.merged(table(spark, sf_dir, "canonical_concepts"))
    return made.select("domain", "concept_family", "name", "concept_id", "canonical_name", F.array_join("preferred_terms", "|").alias("preferred"), F.array_join("synonyms", "|").alias("synonyms"))


def concept_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.coverage(table(spark, sf_dir, "canonical_concepts"))


def concepts_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.resolved_counts(table(spark, sf_dir, "documents"), concepts.terms_of(table(spark, sf_dir, "canonical_concepts")))


def concept_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.resolved(table(spark, sf_dir, "documents"), concepts.terms_of(table(spark, sf_dir, "canonical_concepts")))


def unlisted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.orphans(table(spark, sf_dir, "detected_sections").dropDuplicates(["section_id"]), "canonical_name", table(spark, sf_dir, "section_names"), "canonical_name")


def label_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose language label differs between the documents and the results."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.upper("lang").alias("label"))
    results = table(spark, sf_dir, "understanding_results").where("doc_id is not null").groupBy("doc_id").agg(F.min("language").alias("label"))
    return concepts.differences(docs, results, "doc_id", "label").groupBy("change").agg(F.count("*").alias("n"))


FUNCTIONS = [
    _rule_query(protect.EMAIL_RULE, "detect_emails", True), _rule_query(protect.PHONE_RULE, "detect_phones", True), field_candidates, context_candidates, terms_masked, term_counts, detected_kinds, policy_matrix, *(_deidentify(p) for p in protect.PROFILES),
    masked_emails, decisions, digits_folded, document_flags, file_extensions, script_languages, sections, document_sections, profile_scores, classified, document_contexts, routes, concepts_merged, concept_coverage, concepts_in_text, concept_spans,
    unlisted_sections, label_differences,
]
QUERIES = {f.__name__: f for f in FUNCTIONS} | cases.QUERIES

_AR, _EN = "[^؀-ۿ]", "[^A-Za-z]"
_COUNT = lambda x, r: f"length(regexp_replace({x}, '{r}', '', 'g'))"
_TEXTS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_D = protect.DIGIT
_PHONE_SQL = rf"({_D}*)(\+{protect.BLANK}*965(?:(?:{protect.BLANK}|[().\-])*{_D}){{8}})({_D}*)"
_EMAIL_SQL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9._%+\-]+"


def _rule_sql(rule: tuple, source: str, key: str, extra: str = "") -> str:
    """(key, start_pos, value) of one rule. What the patterns of e-mails and phones say by looking around is said by a wider match and a condition."""
    _, kind, _, pattern, lead, value = rule
    if rule is protect.EMAIL_RULE:
        return f"SELECT * FROM ({_spans_sql(_EMAIL_SQL, source, key, extra=extra)}) WHERE regexp_full_match(value, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}')"
    if rule is protect.PHONE_RULE:
        whole = _spans_sql(_PHONE_SQL, source, key, 1, 2, extra).replace("v[i] AS value", "v[i] AS value, m[i] AS whole")
        return f"SELECT * EXCLUDE (whole) FROM ({whole}) WHERE whole = value"
    return _spans_sql(pattern, source, key, lead, value, extra)


def _found_sql(rules: list, source: str, key: str, extra: str = "") -> str:
    parts = [f"SELECT *, {i} AS seq, '{r[0]}' AS rule, '{r[1]}' AS kind, '{r[2]}' AS source, start_pos + length(value) AS end_pos FROM ({_rule_sql(r, source, key, extra)}) WHERE trim(value) <> ''" for i, r in enumerate(rules)]
    return " UNION ALL ".join(parts)


_FOLD = f"translate(trim(value), '{scalars.OTHER_DIGITS}', '{'0123456789' * 2}')"
_DECISION = rf"""CASE WHEN regexp_full_match(trim(value), '(?i)\[(first_name|last_name|middle_name|user_name|username|occupation|bic|organization|location|person|name)\]') THEN 'reject'
    WHEN kind = 'phone_number' THEN CASE WHEN regexp_full_match(trim(value), '(\+\s*)?{_D}([\s().\-/]*{_D}){{6,14}}') THEN 'accept' ELSE 'review_required' END
    WHEN kind = 'email' THEN CASE WHEN regexp_full_match(trim(value), '(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{{2,}}') THEN 'accept' ELSE 'review_required' END
    WHEN kind = 'civil_id' THEN CASE WHEN regexp_full_match({_FOLD}, '[0-9]{{12}}') THEN 'accept' ELSE 'review_required' END
    WHEN kind IN ('mrn', 'visit_number', 'accession_number', 'specimen_number', 'lab_number', 'document_id', 'employee_number', 'student_number')
        THEN CASE WHEN length(trim(value)) >= 4 AND (regexp_matches(value, '(?i)(MRN|VIS|ACC|SP|LAB|DOC|EMP|STU)[-_]?[A-Z0-9\-]{{3,}}') OR regexp_matches(value, '\p{{Nd}}')) THEN 'accept' ELSE 'review_required' END
    ELSE 'accept' END"""


def _deidentify_sql(profile: str) -> str:
    acts = {t: a for p, t, a in protect.policy_rows() if p == profile}
    act = "CASE kind " + " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in acts.items()) + " ELSE 'keep' END"
    done = "CASE act WHEN 'replace' THEN '[' || upper(kind) || ']' WHEN 'hash' THEN '[' || upper(kind) || ':' || substr(sha256(value), 1, 10) || ']' WHEN 'mask' THEN value WHEN 'remove' THEN '[REMOVED]' ELSE value END"
    return f"""
    WITH c AS ({_found_sql(protect.RULES, DISTINCT, "request_id")}),
    d AS (SELECT *, {_DECISION} AS decision FROM c),
    s AS (SELECT *, CASE source WHEN 'field_rule' THEN 100 ELSE 90 END + CASE decision WHEN 'accept' THEN 100 WHEN 'reject' THEN 10 ELSE 70 END + CASE kind WHEN 'physician_name' THEN 95 ELSE 100 END + 10 AS score FROM d),
    o AS (SELECT request_id, list([{{'s': start_pos, 'e': end_pos, 'kind': kind, 'value': value, 'decision': decision}}] ORDER BY score DESC, start_pos - end_pos, start_pos, seq) AS l FROM s GROUP BY request_id),
    k AS (SELECT request_id, list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND y.e > x[1].s)) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM o),
    u AS (SELECT request_id, unnest(kept) AS x FROM k),
    a AS (SELECT request_id, x.s AS s, x.e AS e, x.kind AS kind, x.value AS value, x.decision AS decision, {act.replace("kind", "x.kind", 1)} AS act FROM u),
    p AS (SELECT request_id, count(*) FILTER (decision = 'accept' AND act <> 'keep') AS n_replaced, count(*) FILTER (decision = 'accept' AND act = 'keep') AS n_kept, count(*) FILTER (decision = 'reject') AS n_rejected,
        count(*) FILTER (decision = 'review_required') AS n_review, list({{'s': s, 'e': e, 't': {done}}} ORDER BY s) FILTER (decision = 'accept' AND act <> 'keep') AS acts FROM a GROUP BY request_id),
    j AS (SELECT r.request_id, r.text, coalesce(n_replaced, 0) AS n_replaced, coalesce(n_kept, 0) AS n_kept, coalesce(n_rejected, 0) AS n_rejected, coalesce(n_review, 0) AS n_review, acts FROM {DISTINCT} r LEFT JOIN p USING (request_id))
    SELECT request_id, CASE WHEN text IS NOT NULL THEN n_replaced END AS n_replaced, CASE WHEN text IS NOT NULL THEN n_kept END AS n_kept, CASE WHEN text IS NOT NULL THEN n_rejected END AS n_rejected, CASE WHEN text IS NOT NULL THEN n_review END AS n_review,
        CASE WHEN text IS NOT NULL THEN 0 END AS n_pending, CASE WHEN text IS NOT NULL THEN n_review = 0 END AS safe, CASE WHEN text IS NOT NULL THEN n_review ELSE -1 END AS warnings,
        CASE WHEN acts IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(acts) + 1), lambda i: text[(CASE WHEN i = 1 THEN 0 ELSE acts[i - 1].e END) + 1 : acts[i].s] || acts[i].t), '') || text[acts[len(acts)].e + 1 :] END AS protected FROM j"""


_NFKC = concepts.compatible_signs()


def _key_sql(x: str) -> str:
    """The compared form of a term: compatible signs made one, small letters, words with single blanks."""
    out = f"translate({x}, '{_NFKC[0].replace(chr(39), chr(39) * 2)}', '{_NFKC[1].replace(chr(39), chr(39) * 2)}')"
    for a, b in concepts.TAKEN_APART.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace(translate(lower({out}), 'ς', 'σ'), '{concepts.GAP}', ' ', 'g'))"


_WORDS_SQL = f"""words AS (SELECT doc_id, regexp_extract_all(text, '{concepts.WORD}') AS w, list_transform(string_split_regex(text, '{concepts.WORD}'), lambda g: length(g)) AS g FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    folded AS (SELECT doc_id, w, g, string_split({_key_sql("array_to_string(w, ' ')")}, ' ') AS f FROM words WHERE len(w) > 0),
    runs AS (SELECT doc_id, w, g, f, i, n, array_to_string(f[i:i+n-1], ' ') AS term FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM folded), (SELECT unnest(range(1, 11)) AS n) WHERE i + n - 1 <= len(w))"""
_CONCEPT_TERMS = f"terms AS (SELECT DISTINCT concept_id, {_key_sql('t')} AS term FROM (SELECT concept_id, unnest(list_concat([canonical_name], coalesce(preferred_terms, []), coalesce(synonyms, []))) AS t FROM canonical_concepts))"
_LOW = lambda i: f"coalesce(list_sum(g[1:{i}]), 0) + coalesce(list_sum(list_transform(w[1:{i}-1], lambda x: length(x))), 0)"
_HEADING = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'))"
SQL = {
    "detect_emails": _rule_sql(protect.EMAIL_RULE, _TEXTS, "doc_id"),
    "detect_phones": _rule_sql(protect.PHONE_RULE, _TEXTS, "doc_id"),
    "detected_kinds": f"""SELECT kind, source, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, start_pos, end_pos, kind, min_by(source, CASE source WHEN 'field_rule' THEN 0 ELSE 1 END) AS source
        FROM ({_found_sql(protect.RULES, _TEXTS, "doc_id")}) GROUP BY doc_id, start_pos, end_pos, kind) GROUP BY ALL""",
    **{f"deidentify_{p}": _deidentify_sql(p) for p in protect.PROFILES},
    "decisions": f"SELECT kind, {_DECISION} AS decision, count(*) AS n FROM ({_found_sql(protect.FIELD_RULES, DISTINCT, 'request_id')}) GROUP BY ALL",
    "field_candidates": _field_sql(protect.FIELD_RULES),
    "context_candidates": _field_sql(protect.CONTEXT_RULES),
    "document_flags": "SELECT doc_id, length(text) AS chars, NOT regexp_matches(text, '[^\\s   -     　\\x1c-\\x1f\\x85]') AS is_empty, substr(sha256(text), 1, 10) AS digest FROM documents WHERE text IS NOT NULL",
    "policy_matrix": f"SELECT profile, action, count(*) AS n, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (VALUES {_POLICY_VALUES}) v(profile, kind, action) GROUP BY ALL",
    "masked_emails": f"""SELECT request_id, start_pos, value AS keep, '[EMAIL]' AS replace, '[EMAIL:' || substr(sha256(value), 1, 10) || ']' AS hash,
        CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE substr(value, 1, 2) || repeat('*', length(value) - 4) || substr(value, length(value) - 1) END AS mask, '[REMOVED]' AS remove
        FROM ({_rule_sql(protect.EMAIL_RULE, DISTINCT, 'request_id')})""",
    "digits_folded": f"SELECT request_id, translate(text, '{scalars.OTHER_DIGITS}', '{'0123456789' * 2}') AS folded FROM {DISTINCT} WHERE text IS NOT NULL",
    "file_extensions": r"SELECT lower(regexp_extract(trim(coalesce(file_path, '')), '(\.[^./\\\s]+)$', 1)) AS extension, count(*) AS n FROM (SELECT DISTINCT * FROM test_matrix) GROUP BY ALL",
    "script_languages": f"""
        SELECT doc_id, CASE WHEN a + e < 4 THEN 'UNKNOWN' WHEN a < 0.3 * (a + e) THEN 'ENGLISH' WHEN e < 0.3 * (a + e) THEN 'ARABIC'
            WHEN al + el > 0 AND least(al, el) >= 0.3 * (al + el) THEN 'MIXED' WHEN al > el THEN 'ARABIC' ELSE 'ENGLISH' END AS language
        FROM (SELECT doc_id, a, e, len(list_filter(p, lambda x: x.a >= 0.3 * (x.a + x.e))) AS al, len(list_filter(p, lambda x: x.e >= 0.3 * (x.a + x.e))) AS el
            FROM (SELECT doc_id, {_COUNT('text', _AR)} AS a, {_COUNT('text', _EN)} AS e,
                list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: {{'a': {_COUNT('x', _AR)}, 'e': {_COUNT('x', _EN)}}}), lambda x: x.a + x.e >= 4) AS p
                FROM documents WHERE text IS NOT NULL))""",
    "routes": """SELECT CASE WHEN upper(confidence_band) IN ('LOW', 'UNKNOWN') OR confidence_band IS NULL THEN 'manual_review' ELSE
        CASE lower(domain) WHEN 'pathology' THEN 'pathology_extraction' WHEN 'laboratory' THEN 'laboratory_extraction' WHEN 'radiology' THEN 'radiology_extraction' WHEN 'emergency' THEN 'emergency_extraction'
            WHEN 'admission_discharge' THEN 'admission_extraction' WHEN 'public_health' THEN 'public_health_extraction' ELSE 'manual_review' END END AS route, count(*) AS n
        FROM (SELECT DISTINCT result_id, domain, confidence_band FROM understanding_results) GROUP BY ALL""",
    "concepts_merged": f"""WITH r AS (SELECT lower(domain) AS domain, lower(concept_family) AS concept_family, {_key_sql('canonical_name')} AS name, concept_id, canonical_name, preferred_terms, synonyms FROM canonical_concepts),
        t AS (SELECT domain, concept_family, name, min(concept_id) AS concept_id, arg_min(canonical_name, concept_id) AS canonical_name, flatten(list(coalesce(preferred_terms, []) ORDER BY concept_id)) AS p, flatten(list(coalesce(synonyms, []) ORDER BY concept_id)) AS s FROM r GROUP BY 1, 2, 3)
        SELECT domain, concept_family, name, concept_id, canonical_name, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), '|') AS preferred, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), '|') AS synonyms FROM t""",
    "concept_coverage": """SELECT facet, value, count(*) AS n FROM (SELECT 'domain' AS facet, domain AS value FROM canonical_concepts UNION ALL SELECT 'family', concept_family FROM canonical_concepts
        UNION ALL SELECT 'status', status FROM canonical_concepts UNION ALL SELECT 'language', unnest(languages) FROM canonical_concepts) GROUP BY ALL""",
    "concepts_in_text": f"WITH {_CONCEPT_TERMS}, {_WORDS_SQL} SELECT doc_id, concept_id, term, count(*) AS n FROM runs JOIN terms USING (term) WHERE term <> '' GROUP BY ALL",
    "concept_spans": f"""WITH {_CONCEPT_TERMS}, {_WORDS_SQL} SELECT doc_id, concept_id, term, CAST({_LOW('i')} AS INT) AS start_pos, CAST({_LOW('(i+n-1)')} + length(w[i+n-1]) AS INT) AS end_pos, array_to_string(w[i:i+n-1], ' ') AS found
        FROM runs JOIN terms USING (term) WHERE term <> ''""",
    "term_counts": f"""WITH v AS (SELECT DISTINCT trim(term) AS term, match_mode, case_sensitive, unnest(list_concat([trim(term)], list_transform(coalesce(aliases, []), lambda x: trim(x)))) AS word, coalesce(category, '') AS category, lower(coalesce(specialty, 'common')) AS specialty
            FROM (SELECT DISTINCT ON (term_id) * REPLACE (lower(coalesce(match_mode, 'word')) AS match_mode, coalesce(case_sensitive, FALSE) AS case_sensitive, coalesce(enabled, TRUE) AS enabled) FROM clinical_terms) WHERE enabled AND trim(term) <> '' AND match_mode IN ('exact', 'word', 'phrase')),
        {_WORDS_SQL}, named AS (SELECT *, {_key_sql('word')} AS key FROM v WHERE word <> ''),
        hit AS (SELECT DISTINCT doc_id, named.term, category, specialty, i, n FROM runs JOIN named ON runs.term = named.key WHERE key <> '' AND match_mode <> 'exact' AND (NOT case_sensitive OR array_to_string(w[i:i+n-1], ' ') = word)
            UNION SELECT doc_id, term, category, specialty, 0, 0 FROM documents JOIN named ON lower(text) = lower(word) WHERE match_mode = 'exact' AND (NOT case_sensitive OR text = word))
        SELECT doc_id, term, count(*) AS n FROM hit GROUP BY ALL""",
    "sections": f"""WITH listed AS (SELECT name, min(canonical_name) AS canonical_name FROM (SELECT canonical_name, {_HEADING.format('alias')} AS name FROM (SELECT canonical_name, unnest(list_concat([title], coalesce(aliases, []))) AS alias FROM section_names) WHERE alias IS NOT NULL) GROUP BY name),
        lines AS (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
        heads AS (SELECT doc_id, length(text) AS n, regexp_extract(ls[i], '^[ \t]*([^:\r]{{2,60}}?)[ \t]*(:.*)?\r?$', 1) AS heading, CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) + length(regexp_extract(ls[i], '^[ \t]*', 0)) AS INT) AS start_pos FROM lines),
        hits AS (SELECT doc_id, n, canonical_name, heading, start_pos FROM heads JOIN listed ON listed.name = {_HEADING.format('heading')} WHERE heading <> '')
        SELECT doc_id, canonical_name, heading AS original_heading, start_pos, coalesce(lead(start_pos) OVER (PARTITION BY doc_id ORDER BY start_pos), n) AS end_pos FROM hits""",
    "unlisted_sections": """SELECT canonical_name AS value, count(*) AS n FROM (SELECT DISTINCT section_id, canonical_name FROM detected_sections) WHERE canonical_name IS NOT NULL
        AND canonical_name NOT IN (SELECT canonical_name FROM section_names WHERE canonical_name IS NOT NULL) GROUP BY ALL""",
    "label_differences": """SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.label IS DISTINCT FROM b.label THEN 'changed' END AS change
        FROM (SELECT doc_id, upper(lang) AS label FROM documents) a FULL JOIN (SELECT doc_id, min(language) AS label FROM understanding_results WHERE doc_id IS NOT NULL GROUP BY doc_id) b ON a.doc_id = b.doc_id) WHERE change IS NOT NULL GROUP BY ALL""",
}
SQL |= cases.SQL
