"""Terms of a clinical vocabulary: found by section, document type and specialty, counted, and protected by numbered tokens while a text is processed.

A vocabulary is a table with the columns of ``VOCABULARY``. What is applied within a text (``matches``, ``protected``, ``protected_by_section``)
takes the terms as a list and builds one alternation, meant for a few hundred curated terms; ``term_counts`` joins a table of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.scalars import LINE_BREAK, bound
from wardloom.operators import concepts
from wardloom.operators.spans import located, rewritten

TOKEN = "__CTX_%04d__"
VOCABULARY = "term string, category string, specialty string, sections array<string>, aliases array<string>, document_types array<string>, match_mode string, case_sensitive boolean, enabled boolean, source string"
COMMON, OWN_SOURCE = "common", "wardloom"
# Ways to match, and the categories that aren't masked.
MATCH_MODES, UNMASKED = ("exact", "word", "phrase"), ("clinical_occupation", "clinical_specialty")
# Sections that a term of laboratories or of pathology stands in.
AUTHORIZING = "authorized_by approved_by validated_by verified_by reported_by signed_by consultant".split()
PATHOLOGICAL = "gross_description microscopic_description diagnosis final_diagnosis comment interpretation".split() + AUTHORIZING
# Terms by category and specialty, with their aliases.
COMMON_TERMS = [
    ("Physician", COMMON, ""), ("Doctor", COMMON, "Dr|Dr."), ("Consultant", COMMON, ""), ("Specialist", COMMON, ""), ("Resident", COMMON, ""), ("Registrar", COMMON, ""), ("Medical Officer", COMMON, ""), ("Surgeon", "surgery", ""),
]
LABORATORY_TERMS = [
    ("Clinical Pathologist", "pathology", "Consultant Clinical Pathologist|Specialist Clinical Pathologist"), ("Pathologist", "pathology", "Consultant Pathologist|Specialist Pathologist"),
    ("Laboratory Physician", "laboratory_medicine", "Lab Physician|Clinical Laboratory Physician"), ("Laboratory Consultant", "laboratory_medicine", "Lab Consultant|Consultant Laboratory Medicine"),
    ("Medical Laboratory Scientist", "laboratory_medicine", "Clinical Laboratory Scientist|Biomedical Scientist"), ("Medical Technologist", "laboratory_medicine", "Laboratory Technologist|Lab Technologist"),
    ("Laboratory Technician", "laboratory_medicine", "Lab Technician|Medical Laboratory Technician"), ("Microbiologist", "microbiology", "Clinical Microbiologist|Consultant Microbiologist"),
    ("Hematologist", "laboratory_medicine", "Clinical Hematologist|Consultant Hematologist"), ("Clinical Biochemist", "laboratory_medicine", "Medical Biochemist|Consultant Clinical Biochemist"),
]
PATHOLOGY_TERMS = [
    ("Pathologist", "clinical_occupation", "Clinical Pathologist|Anatomical Pathologist|Anatomic Pathologist|Surgical Pathologist|Consultant Pathologist|Specialist Pathologist|Consultant Clinical Pathologist"),
    ("Histopathologist", "clinical_occupation", "Consultant Histopathologist|Specialist Histopathologist"), ("Cytopathologist", "clinical_occupation", "Consultant Cytopathologist|Specialist Cytopathologist"),
    ("Histology Technician", "clinical_occupation", "Histotechnologist|Histotechnician"), ("Gross Examination", "pathology_term", "Gross Description|Macroscopic Examination|Macroscopic Description"),
    ("Microscopic Examination", "pathology_term", "Microscopic Description|Histological Examination|Histologic Examination"),
    ("Biopsy", "procedure", "Core Biopsy|Needle Biopsy|Excisional Biopsy|Incisional Biopsy"), ("Resection", "procedure", "Surgical Resection|Resection Specimen"),
    ("Carcinoma", "diagnosis", "Adenocarcinoma|Squamous Cell Carcinoma|Invasive Carcinoma"), ("Malignancy", "diagnosis", "Malignant Neoplasm|Malignant Tumor|Malignant Tumour"),
    ("Necrosis", "pathology_term", "Tumor Necrosis|Tumour Necrosis|Coagulative Necrosis"), ("Margins", "pathology_term", "Surgical Margins|Resection Margins|Margin Status"),
    ("Immunohistochemistry", "procedure", "Immunohistochemical Staining|IHC"), ("Differentiation", "pathology_term", "Well Differentiated|Moderately Differentiated|Poorly Differentiated"),
    ("Lymphovascular Invasion", "pathology_term", "Lymphatic Invasion|Vascular Invasion|LVI"),
]
# Further words masked in three sections.
SECTION_WORDS = {
    "gross_description": "white pink brown yellow firm soft friable necrosis necrotic capsule capsular fibrotic calcified calcification margin margins lymphovascular specimen tissue",
    "microscopic_description": "ductal carcinoma grade margins lymphovascular invasion positive negative cells",
    "diagnosis": "carcinoma adenocarcinoma sarcoma lymphoma metastatic positive negative er pr her2 ki67",
}
# Lines that are a heading, by the section they open.
HEADINGS = {
    "patient_information": "patient|patient name|civil id|mrn|date of birth", "specimen": "specimen|specimen number|accession number",
    "gross_description": "gross description|macroscopic description|macroscopic examination",
    "microscopic_description": "microscopic description|microscopic examination|histological examination|histologic examination",
    "diagnosis": "diagnosis|final diagnosis|impression|interpretation|comment",
    "consultant": "consultant|consultant pathologist|reporting physician|authorized by|approved by|validated by|verified by|reported by|signed by",
}
SECTION_OF = {h: s for s, hs in HEADINGS.items() for h in hs.split("|")}
# Types of documents that a section's terms are looked up for when the document's isn't known.
TYPES_OF_SECTION = {**dict.fromkeys(("gross_description", "microscopic_description", "diagnosis"), ("pathology_report",)), "consultant": ("laboratory_report", "pathology_report")}


def row(term: str, category: str, specialty: str = COMMON, sections: Sequence[str] = (), aliases: Sequence[str] = (), document_types: Sequence[str] = (), match_mode: str = "word", case_sensitive: bool = False, enabled: bool = True, source: str = OWN_SOURCE) -> tuple:
    """One term in its agreed form: values trimmed, blank ones and repetitions (whatever their case) dropped."""
    if not term.strip():
        raise ValueError("a term must not be blank")
    if match_mode not in MATCH_MODES:
        raise ValueError(f"unknown match mode {match_mode}")
    several = lambda values: list({v.strip().lower(): v.strip() for v in reversed(values) if v.strip()}.values())[::-1]
    return term.strip(), category, specialty, several(sections), several(aliases), several(document_types), match_mode, case_sensitive, enabled, source.strip() or OWN_SOURCE


def default_rows() -> list[tuple]:
    """The terms that come with the library: common, of laboratories, and of pathology."""
    split = lambda a: tuple(x for x in a.split("|") if x)
    return (
        [row(t, "clinical_occupation", s, aliases=split(a)) for t, s, a in COMMON_TERMS]
        + [row(t, "clinical_occupation", s, AUTHORIZING, split(a), ("laboratory_report",)) for t, s, a in LABORATORY_TERMS]
        + [row(t, c, "pathology", PATHOLOGICAL, split(a), ("pathology_report",)) for t, c, a in PATHOLOGY_TERMS]
    )


def default_vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_rows(), VOCABULARY)


# -- tables of terms


def normalised(vocabulary: DataFrame) -> DataFrame:
    """A table of terms in its agreed form; terms that are null or blank, or matched in an unknown way, are left out. Missing columns get their default."""
    has = set(vocabulary.columns)
    lists = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "") if c in has else F.array().cast("array<string>")
    first = lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, 1, i), lambda y: F.lower(y) == F.lower(x)))
    plain = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in has else F.lit(default)
    out = vocabulary.select(
        F.trim("term").alias("term"), plain("category", "").alias("category"), F.lower(plain("specialty", COMMON)).alias("specialty"), *[first(lists(c)).alias(c) for c in ("sections", "aliases", "document_types")],
        F.lower(plain("match_mode", "word")).alias("match_mode"), plain("case_sensitive", False).alias("case_sensitive"), plain("enabled", True).alias("enabled"), F.coalesce(F.nullif(F.trim(plain("source", "")), F.lit("")), F.lit(OWN_SOURCE)).alias("source"),
    )
    return out.where((F.col("term") != "") & F.col("match_mode").isin(*MATCH_MODES))


def registered(vocabulary: DataFrame, added: DataFrame) -> DataFrame:
    """``vocabulary`` with the specialties of ``added`` replaced by its terms."""
    return vocabulary.join(added.select("specialty").distinct(), "specialty", "left_anti").select(vocabulary.columns).unionByName(added)


def unregistered(vocabulary: DataFrame, specialty: str) -> DataFrame:
    return vocabulary.where(F.lower("specialty") != specialty.lower())


def of_specialties(vocabulary: DataFrame, specialties: Sequence[str] | None = None) -> DataFrame:
    """Enabled terms, of these specialties and the common ones, or of all."""
    if isinstance(specialties, str):
        raise TypeError("specialties are a list of names")
    v = vocabulary.where("enabled")
    return v if specialties is None else v.where(F.lower("specialty").isin(COMMON, *[s.lower() for s in specialties]))


def applying(vocabulary: DataFrame, section: str | None = None, document_type: str | None = None, specialties: Sequence[str] | None = None) -> DataFrame:
    """Terms that apply in a section of a type of document; terms that name none apply in all, others need one that they name."""
    fits = lambda c, v: (F.size(c) == 0) | (F.exists(c, lambda x: F.lower(x) == v.strip().lower()) if v is not None else F.lit(False))
    return of_specialties(vocabulary, specialties).where(fits("sections", section) & fits("document_types", document_type))


def words_of(vocabulary: DataFrame) -> DataFrame:
    """(term, specialty, category, match_mode, case_sensitive, word): the terms and their aliases."""
    return vocabulary.select("term", "specialty", "category", "match_mode", "case_sensitive", F.explode(F.concat(F.array("term"), "aliases")).alias("word"))


def term_counts(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, specialty, category, n): how often each enabled term of a table, under any of its names, stands in each text.

    Terms of any number meet the texts by equi-joins of words. Nested and overlapping matches all count. Terms that mind
    their case are compared as stored, those matched exactly with the whole text.
    """
    v = words_of(of_specialties(vocabulary)).withColumn("concept_id", F.xxhash64("term", "specialty", "category", "match_mode", "case_sensitive", "word"))
    v = v.dropDuplicates(["concept_id"])
    named = v.select("concept_id", concepts.term_key(F.col("word")).alias("term")).where("term != ''")
    docs = docs.where(F.col(text).isNotNull())
    whole = v.where("match_mode = 'exact'")
    hits = concepts.resolved(docs, named, key, text).join(v.select("concept_id", "specialty", "category", "match_mode", "case_sensitive", "word", F.col("term").alias("t")), "concept_id")
    word = hits.where("match_mode != 'exact' and (not case_sensitive or found = word)").select(key, F.col("t").alias("term"), "specialty", "category", "start_pos", "end_pos")
    same = F.when(F.col("case_sensitive"), F.col("_t") == F.col("word")).otherwise(F.lower("_t") == F.lower("word"))
    exact = docs.select(F.col(key), F.col(text).alias("_t"), F.lower(text).alias("_l")).join(whole.withColumn("_l", F.lower("word")), "_l").where(same).select(key, "term", "specialty", "category", F.lit(0).alias("start_pos"), F.length("_t").alias("end_pos"))
    return word.unionByName(exact).distinct().groupBy(key, "term", "specialty", "category").agg(F.count("*").alias("n"))


# -- within a text


def quoted(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term.strip()).replace(" ", r"\s+")


NOT_WORD = r"[\p{L}\p{N}_]"
NEVER = "(?!)"


def pattern(terms: Iterable[str], cased: Iterable[str] = (), whole: Iterable[str] = ()) -> str:
    """One alternation, the longest terms first; terms stand alone, whatever their case but for those in ``cased``; those in ``whole`` are all of the text."""
    free = [(t, f"{quoted(t)}") for t in terms if t.strip()] + [(t, f"(?-iu:{quoted(t)})") for t in cased if t.strip()]
    parts = [p for _, p in sorted({*free}, key=lambda x: (-len(x[0]), x[0], x[1]))]
    exact = [rf"\A{quoted(t)}\z" for t in sorted(whole, key=lambda t: (-len(t), t)) if t.strip()]
    if not parts and not exact:
        raise ValueError("no terms")
    return "(?iu)(?:" + "|".join([*exact, *([rf"(?<!{NOT_WORD})(?:{'|'.join(parts)})(?!{NOT_WORD})"] if parts else [])]) + ")"


def pattern_of(rows: Sequence[tuple]) -> str:
    """The alternation of rows of a vocabulary, their aliases included."""
    by = {"free": [], "cased": [], "whole": []}
    for r in rows:
        kind = "whole" if r[6] == "exact" else "cased" if r[7] else "free"
        by[kind] += [r[0], *r[4]]
    return pattern(by["free"], by["cased"], by["whole"]) if any(by.values()) else NEVER


def selected(rows: Sequence[tuple], section: str | None = None, document_type: str | None = None, specialties: Sequence[str] | None = None, without: Sequence[str] = ()) -> list[tuple]:
    """As ``applying``, on a list of rows, without some categories."""
    wanted = None if specialties is None else {COMMON, *(s.lower() for s in specialties)}
    fits = lambda values, v: not values or v is not None and v.strip().lower() in {x.lower() for x in values}
    return [r for r in rows if r[8] and r[1] not in without and (wanted is None or r[2].lower() in wanted) and fits(r[3], section) and fits(r[5], document_type)]


def matches(text: Column, rows: Sequence[tuple], **where: object) -> Column:
    """array<struct<start_pos, end_pos, value, term>>: the terms that apply, left to right, the longest first, without overlaps. Ties between terms go to the first by name."""
    chosen = selected(rows, **where)
    name = {}
    for r in sorted(chosen, key=lambda r: r[0].lower(), reverse=True):
        name |= {" ".join(w.lower().split()): r[0] for w in (r[0], *r[4])}
    key = lambda v: F.lower(F.regexp_replace(v, r"\s+", " "))
    table = F.create_map(*[F.lit(x) for kv in (name or {"": ""}).items() for x in kv])
    return F.transform(located(text, pattern_of(chosen)), lambda x: F.struct(x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), x["value"].alias("value"), table[key(x["value"])].alias("term")))


def contains(text: Column, rows: Sequence[tuple], **where: object) -> Column:
    return text.rlike(pattern_of(selected(rows, **where)))


def matched_terms(text: Column, rows: Sequence[tuple], **where: object) -> Column:
    """The distinct terms of a text in the order in which they first stand there."""
    return F.array_distinct(F.transform(matches(text, rows, **where), lambda x: x["term"]))


def _numbered(spans: Column, first: Column, token: str) -> Column:
    return F.transform(spans, lambda x, i: F.struct(x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), F.format_string(token, first + i).alias("replacement"), x["value"].alias("value")))


def protected(text: Column, terms: list[str], token: str = TOKEN) -> Column:
    """struct<text, tokens: array<struct<token, value>>>: each term replaced by a token numbered in the order of the text."""
    return protected_matches(text, [pattern(terms)], token)


def protected_matches(text: Column, patterns: Sequence[str], token: str = TOKEN) -> Column:
    """As ``protected``, for patterns applied one after another; tokens are numbered on."""
    zero = F.struct(text.alias("text"), F.array().cast("array<struct<token:string,value:string>>").alias("tokens"))
    return F.aggregate(F.array(*map(F.lit, patterns)), zero, lambda a, p: _replaced(a, p, token)) if patterns else zero


def _replaced(a: Column, p: Column, token: str) -> Column:
    made = lambda spans: F.struct(rewritten(a["text"], spans).alias("text"), F.concat(a["tokens"], F.transform(spans, lambda x: F.struct(x["replacement"].alias("token"), x["value"].alias("value")))).alias("tokens"))
    return bound(_numbered(located(a["text"], p), F.size(a["tokens"]) + 1, token), made)


def restored(text: Column, tokens: Column) -> Column:
    """``text`` with every token replaced by the value it stands for; the last first, since a value may hold an earlier token."""
    return F.aggregate(F.reverse(tokens), text, lambda a, x: F.replace(a, x["token"], x["value"]))


def heading_form(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")), ":+$", ""), r"\s+", " "))


def section_of(line: Column) -> Column:
    """The section that a line opens; null for lines that are no heading."""
    return F.create_map(*[F.lit(x) for kv in SECTION_OF.items() for x in kv])[heading_form(line)]


def sections_present(text: Column) -> Column:
    """The sections that a text's headings open, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, LINE_BREAK), section_of), lambda x: x.isNotNull()))


def line_sections(text: Column) -> Column:
    """array<struct<line, section>>: the lines of a text and the section that each stands in, null before the first heading."""
    kind = "array<struct<line:string,section:string>>"
    zero = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast(kind).alias("out"))

    def step(a: Column, line: Column) -> Column:
        now = F.coalesce(section_of(line), a["now"])
        return F.struct(now.alias("now"), F.concat(a["out"], F.array(F.struct(line.alias("line"), now.alias("section")))).alias("out"))

    return F.aggregate(F.split(text, LINE_BREAK), zero, step, lambda a: a["out"])


def passes(rows: Sequence[tuple], document_type: str | None = None) -> dict[str, list[str]]:
    """For each section ('' for none) the patterns that mask its lines one after another: terms for each type of document, common ones, then single words."""
    out = {}
    for s in ("", *HEADINGS):
        section = s or None
        types = (document_type,) if document_type else TYPES_OF_SECTION.get(s, ())
        found = [pattern_of(selected(rows, section, t, without=UNMASKED)) for t in (*types, None)]
        words = SECTION_WORDS.get(s, "").split()
        out[s] = [p for p in [*found, *([r"(?iu)\b(?:" + "|".join(sorted(map(quoted, words), key=lambda w: (-len(w), w))) + r")\b"] if words else [])] if p != NEVER]
    return out


def protected_by_section(text: Column, rows: Sequence[tuple] | None = None, document_type: str | None = None) -> Column:
    """struct<text, tokens>: the terms that apply in each line's section replaced by tokens, line by line; headings stay.

    Tokens are numbered by line, then pass, then place. Occupations and specialties aren't masked.
    """
    by = passes(default_rows() if rows is None else rows, document_type)
    kind = "array<struct<token:string,value:string>>"
    table = F.create_map(*[x for s, ps in by.items() for x in (F.lit(s), F.array(*map(F.lit, ps)) if ps else F.array().cast("array<string>"))])
    breaks = F.concat(F.regexp_extract_all(text, F.lit(f"({LINE_BREAK})"), F.lit(1)), F.array(F.lit("")))
    lines = F.arrays_zip(F.split(text, LINE_BREAK).alias("line"), breaks.alias("end"))
    zero = F.struct(F.lit("").alias("now"), F.lit("").alias("text"), F.array().cast(kind).alias("tokens"))

    def step(a: Column, x: Column) -> Column:
        opened = section_of(x["line"])
        patterns = F.when(opened.isNull(), table[a["now"]]).otherwise(F.array().cast("array<string>"))
        masked = F.aggregate(patterns, F.struct(x["line"].alias("text"), a["tokens"].alias("tokens")), lambda b, p: _replaced(b, p, TOKEN))
        return bound(masked, lambda r: F.struct(F.coalesce(opened, a["now"]).alias("now"), F.concat(a["text"], r["text"], x["end"]).alias("text"), r["tokens"].alias("tokens")))

    return F.aggregate(lines, zero, step, lambda a: F.struct(a["text"].alias("text"), a["tokens"].alias("tokens")))


def nearest(left: DataFrame, right: DataFrame, key: str, most: int = 120) -> DataFrame:
    """Each span of ``left`` (key, start_pos, end_pos, label) with the label of the nearest span of ``right`` in the same record, at most ``most`` signs away.

    Overlapping spans have no distance; ties go to the span that begins first. The join is by record, so it is bounded by
    what one record holds.
    """
    r = right.select(F.col(key), F.col("start_pos").alias("s"), F.col("end_pos").alias("e"), F.col("label").alias("near"))
    gap = F.greatest(F.col("s") - F.col("end_pos"), F.col("start_pos") - F.col("e"), F.lit(0))
    pairs = left.join(r, key).withColumn("gap", gap).where(F.col("gap") <= most)
    return pairs.groupBy(key, "start_pos", "end_pos", "label").agg(F.min(F.struct("gap", "s", "near")).alias("m")).select(key, "start_pos", "end_pos", "label", F.col("m.near").alias("near"), F.col("m.gap").alias("gap"))
