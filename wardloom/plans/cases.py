"""Documented cases of the operators as queries: a few literal rows go through an operator, and the SQL states what must come out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions import scalars
from wardloom.operators import candidates, concepts, terms
from wardloom.plans import compat, protect, radiology, understand
from wardloom.session import put
from wardloom.sources import files, terminology
from wardloom.streaming import documents as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return repr(x)
    parts = ["'" + p.replace("'", "''") + "'" for p in str(x).split("\n")]
    return " || chr(10) || ".join(parts) if len(parts) > 1 else parts[0]


def case(columns: str, *expected: tuple) -> Callable:
    """Register a query and the rows that it must give, as SQL of literals."""

    def add(run: Callable[[SparkSession], DataFrame]) -> Callable:
        names = columns.split()
        QUERIES[run.__name__] = lambda spark, sf_dir: run(spark).select(*names)
        rows = ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in expected)
        SQL[run.__name__] = f"SELECT * FROM (VALUES {rows}) t({', '.join(names)})"
        return run

    return add


def texts(spark: SparkSession, rows: list[str | None]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows, 1)), "id int, text string")


def listed(x: F.Column, part: Callable = lambda y: y) -> F.Column:
    return F.array_join(F.transform(x, part), "|")


# -- labels, roles, decisions, overlaps


@case(
    "id form kind", (1, "first_name", "person_name"), (2, "phone_number", "phone_number"), (3, "bic", "unknown"), (4, "occupation", "professional_role"), (5, "next_of_kin", "relative_name"), (6, "national_id", "civil_id"), (7, "", "unknown"),
    (8, "date_time", "general_date"), (9, "e_mail", "email"), (10, "quantum", "unknown"), (11, "patient_id", "mrn"), (12, "record_checksum", "document_id"),
)
def label_cases(spark):
    t = texts(spark, ["FIRST-NAME", "Phone Number", "<BIC>", "[occupation]", " Next  of Kin ", "national-id", "", "Date-Time", "E-Mail", "quantum", "Patient ID", "(record checksum)"])
    return t.select("id", candidates.label_form(F.col("text")).alias("form"), candidates.kind_of(F.col("text")).alias("kind"))


def _one(spark, rows):
    """(id, text, kind, label, value): one candidate a row, where the value first stands in the text."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "id int, text string, kind string, label string, value string")
    at = F.instr("text", F.col("value")) - 1
    x = candidates.struct(seq=F.lit(1), source=F.lit("external"), label=F.col("label"), kind=F.col("kind"), start_pos=at, end_pos=at + F.length("value"), value=F.col("value"), confidence=F.lit(0.9))
    return df.withColumn("found", F.array(x))


@case(
    "id kind", (1, "patient_name"), (2, "patient_name"), (3, "physician_name"), (4, "nurse_name"), (5, "guardian_name"), (6, "relative_name"), (7, "employee_name"), (8, "student_name"), (9, "person_name"), (10, "email"), (11, "physician_name"),
    (12, "patient_name"), (13, "person_name"),
)
def role_cases(spark):
    rows = [
        ("Patient Name: Ahmed Hassan", "person_name", None, "Ahmed Hassan"), ("Patient Name:\nAhmed Hassan", "person_name", None, "Ahmed Hassan"), ("Reporting Radiologist: Dr. Mona Ali", "person_name", None, "Mona Ali"),
        ("Triage Nurse: Sara Omar", "unknown", None, "Sara Omar"), ("Parent Name: Adel Noor", "person_name", None, "Adel Noor"), ("Next of kin: Lina Saad", "person_name", None, "Lina Saad"), ("Staff Name: Omar Zaki", "person_name", None, "Omar Zaki"),
        ("اسم الطالب: سالم ناصر", "person_name", None, "سالم ناصر"), ("Seen with Ann Bell today", "person_name", None, "Ann Bell"), ("Patient: a@b.com", "email", None, "a@b.com"), ("Authorized By\n\nDr. Huda Noor", "person_name", None, "Huda Noor"),
        ("المريضة: ليلى حسن", "person_name", None, "ليلى حسن"), ("Comment: seen by Ann Bell", "person_name", None, "Ann Bell"),
    ]
    return _one(spark, rows).select("id", candidates.with_roles(F.col("text"), F.col("found"))[0]["kind"].alias("kind"))


@case(
    "id decision", (1, "reject"), (2, "accept"), (3, "review_required"), (4, "accept"), (5, "review_required"), (6, "accept"), (7, "accept"), (8, "review_required"), (9, "accept"), (10, "review_required"), (11, "accept"), (12, "accept"),
    (13, "accept"), (14, "reject"), (15, "reject"), (16, "review_required"), (17, "reject"), (18, "reject"), (19, "review_required"), (20, "accept"), (21, "review_required"), (22, "review_required"), (23, "review_required"), (24, "accept"),
    (25, "accept"), (26, "accept"), (27, "review_required"), (28, "accept"),
)
def decision_cases(spark):
    rows = [
        ("by [first_name] here", "person_name", None, "[first_name]"), ("Tel +965 1234 5678", "phone_number", None, "+965 1234 5678"), ("Tel 12-3", "phone_number", None, "12-3"), ("to a@b.com", "email", None, "a@b.com"), ("to a@b", "email", None, "a@b"),
        ("id 123456789012", "civil_id", None, "123456789012"), ("id ١٢٣٤٥٦٧٨٩٠١٢", "civil_id", None, "١٢٣٤٥٦٧٨٩٠١٢"), ("id 12345678901", "civil_id", None, "12345678901"), ("no MRN-ABC", "mrn", None, "MRN-ABC"), ("no ABCD", "mrn", None, "ABCD"),
        ("no X1Y2", "visit_number", None, "X1Y2"), ("no Q", "insurance_number", None, "Q"), ("at 5 Hill Street", "address", None, "5 Hill Street"), ("the Radiologist said", "professional_role", "occupation", "Radiologist"),
        ("Reported by: chief of staff", "professional_role", "occupation", "chief of staff"), ("a baker came", "professional_role", "occupation", "baker"), ("CONFIDENTIAL MEDICAL DOCUMENT", "unknown", None, "DOCUMENT"),
        ("This medical record ABCD", "unknown", "BIC", "ABCD"), ("value ABCD", "unknown", None, "ABCD"), ("Patient full name: Ann Bell", "person_name", None, "Ann Bell"), ("Met Ann Bell", "person_name", None, "Ann Bell"),
        ("in City Hospital", "organization", None, "City Hospital"), ("in Kuwait", "location", None, "Kuwait"), ("on 01/02/2024", "general_date", None, "01/02/2024"), ("on 01/02/2024", "date_of_birth", None, "01/02/2024"),
        ("Dr. Huda", "physician_name", None, "Huda"), ("x y", "department", None, "x"), ("Guardian: Adel", "guardian_name", None, "Adel"),
    ]
    return _one(spark, rows).select("id", candidates.decided(F.col("text"), F.col("found"))[0]["decision"].alias("decision"))


@case("id decision", (1, "review_required"), (2, "keep"), (3, "reject"))
def standing_decision_cases(spark):
    """Offsets that don't hold the value need a review; what is decided stays."""
    df = spark.createDataFrame([(1, "pending", 3), (2, "keep", 3), (3, "reject", 0)], "id int, d string, at int").withColumn("text", F.lit("Ann Bell"))
    x = candidates.struct(source=F.lit("external"), kind=F.lit("patient_name"), start_pos=F.col("at"), end_pos=F.col("at") + 3, value=F.lit("Ann"), decision=F.col("d"))
    return df.select("id", candidates.decided(F.col("text"), F.array(x))[0]["decision"].alias("decision"))


def _sets(spark, rows):
    """(id, found) of candidates (id, source, kind, start, end, confidence, decision)."""
    df = spark.createDataFrame([(r[0], i, *r[1:]) for i, r in enumerate(rows)], "id int, seq int, source string, kind string, s int, e int, c double, d string")
    x = candidates.struct(seq=F.col("seq"), source=F.col("source"), kind=F.col("kind"), start_pos=F.col("s"), end_pos=F.col("e"), value=F.repeat(F.lit("x"), F.col("e") - F.col("s")), confidence=F.col("c"), decision=F.col("d"))
    return df.groupBy("id").agg(F.array_sort(F.collect_list(x)).alias("found"))


@case(
    "id kept", (1, "field_rule patient_name 0-8"), (2, "arabic_rule patient_name 0-8"), (3, "external patient_name 0-8"), (4, "external patient_name 0-8"), (5, "external person_name 0-12"), (6, "external person_name 0-8"),
    (7, "field_rule mrn 5-10|inline_rule email 12-20"), (8, "field_rule mrn 5-15"), (9, "external person_name 4-8"), (10, "field_rule civil_id 0-4|field_rule civil_id 4-8"),
)
def merge_cases(spark):
    rows = [
        (1, "external", "person_name", 0, 8, 0.99, "accept"), (1, "field_rule", "patient_name", 0, 8, 1.0, "accept"), (2, "external", "patient_name", 0, 8, 0.9, "accept"), (2, "arabic_rule", "patient_name", 0, 8, 0.9, "accept"),
        (3, "external", "patient_name", 0, 8, 0.9, "accept"), (3, "external", "patient_name", 0, 8, 0.95, "reject"), (4, "external", "person_name", 0, 8, 0.9, "accept"), (4, "external", "patient_name", 0, 8, 0.9, "accept"),
        (5, "external", "person_name", 0, 8, 0.9, "accept"), (5, "external", "person_name", 0, 12, 0.9, "accept"), (6, "external", "person_name", 0, 8, 0.91, "accept"), (6, "external", "person_name", 0, 8, 0.97, "accept"),
        (7, "inline_rule", "mrn", 0, 10, 1.0, "accept"), (7, "field_rule", "mrn", 5, 10, 1.0, "accept"), (7, "inline_rule", "email", 12, 20, 1.0, "accept"), (8, "field_rule", "mrn", 5, 15, 1.0, "accept"), (8, "inline_rule", "mrn", 0, 10, 1.0, "accept"),
        (9, "external", "person_name", 2, 6, 0.91, "accept"), (9, "external", "person_name", 4, 8, 0.98, "accept"), (10, "field_rule", "civil_id", 4, 8, 1.0, "accept"), (10, "field_rule", "civil_id", 0, 4, 1.0, "accept"),
    ]
    return _sets(spark, rows).select("id", listed(candidates.settled(F.col("found")), lambda x: F.concat_ws(" ", x["source"], x["kind"], F.concat_ws("-", x["start_pos"], x["end_pos"]))).alias("kept"))


@case("id score", (1, 310), (2, 199), (3, 160), (4, 305), (5, 210), (6, 150))
def score_cases(spark):
    rows = [
        (1, "field_rule", "mrn", 0, 4, 1.0, "accept"), (2, "external", "general_date", 0, 4, 0.95, "accept"), (3, "external", "exam_date", 0, 4, 1.0, "accept"), (4, "field_rule", "physician_name", 0, 4, 1.0, "accept"),
        (5, "external", "mrn", 0, 4, 1.0, "pending"), (6, "external", "unknown", 0, 4, None, "keep"),
    ]
    return _sets(spark, rows).select("id", candidates.score(F.col("found")[0]).alias("score"))


@case("id sound stands width", (1, True, True, 3), (2, True, False, 3), (3, False, True, 3), (4, False, False, 0), (5, False, True, 3), (6, False, False, 3))
def contract_cases(spark):
    df = spark.createDataFrame(
        [(1, 0, 3, "Ann", 0.5, "external"), (2, 1, 4, "Ann", None, "external"), (3, 0, 3, "Ann", 1.5, "external"), (4, 2, 2, "", 0.5, "external"), (5, 0, 3, "Ann", 0.5, "elsewhere"), (6, -1, 2, "Ann", 0.5, "external")],
        "id int, s int, e int, v string, c double, source string",
    ).withColumn("x", candidates.struct(source=F.col("source"), kind=F.lit("person_name"), start_pos=F.col("s"), end_pos=F.col("e"), value=F.col("v"), confidence=F.col("c")))
    text = F.lit("Ann Bell")
    return df.select("id", candidates.sound(F.col("x")).alias("sound"), F.coalesce(candidates.stands(text, F.col("x")) & (F.col("s") >= 0) & (F.col("e") > F.col("s")), F.lit(False)).alias("stands"), candidates.width(F.col("x")).alias("width"))


ENTITIES = "array<struct<text:string,start:string,end_index:string,raw_label:string,canonical_label:string,score:string,model_id:string,evidence:struct<normalized_start:int,normalized_end:int>>>"


def _external(spark):
    t = "Seen Ann Bell, a@b.com"
    rows = [
        (1, t, [("wrong", "5", "13", "NAME", None, "0.95", "m1", None)]), (2, t, [(None, None, None, "email", None, "1.5", None, (15, 22))]), (3, t, [("x", "5", "99", "name", None, "0.5", None, None)]), (4, t, [("x", "7.0", "13", None, "last_name", "abc", None, None)]),
        (5, t, [("x", "5.5", "13", "name", None, "0.5", None, None), ("y", "-1", "3", "name", None, "0.5", None, None), ("z", "13", "13", "name", None, "0.5", None, None)]), (6, t, None), (7, t, []),
    ]
    return spark.createDataFrame(rows, f"id int, text string, entities {ENTITIES}")


@case("id value start_pos end_pos label kind confidence", (1, "Ann Bell", 5, 13, "NAME", "person_name", 0.95), (2, "a@b.com", 15, 22, "email", "email", None), (4, "n Bell", 7, 13, "last_name", "person_name", None))
def recogniser_cases(spark):
    df = _external(spark)
    found = candidates.typed(candidates.of_recogniser(F.col("text"), F.col("entities"), df.schema["entities"].dataType))
    return df.select("id", F.inline(found))


@case("id metadata", (1, 'model_id="m1"'), (2, 'evidence={"normalized_start":15,"normalized_end":22}'))
def recogniser_metadata_cases(spark):
    df = _external(spark).where("id <= 2")
    names = df.schema["entities"].dataType.elementType.fieldNames()
    m = candidates.recogniser_metadata(F.col("entities")[0], names)
    return df.select("id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("metadata"))


@case(
    "id n_replaced n_review safe warnings protected", (1, 1, 1, False, "to review: 'Ann Bell' (person_name) at 5:13", "Seen Ann Bell, [EMAIL]"), (2, 1, 0, True, "", "Seen Ann Bell, [EMAIL]"), (3, 1, 0, True, "", "Seen Ann Bell, [EMAIL]"),
    (4, 1, 1, False, "to review: 'n Bell' (person_name) at 7:13", "Seen Ann Bell, [EMAIL]"), (5, 1, 0, True, "", "Seen Ann Bell, [EMAIL]"), (6, 1, 0, True, "", "Seen Ann Bell, [EMAIL]"), (7, 1, 0, True, "", "Seen Ann Bell, [EMAIL]"),
)
def recogniser_pipeline_cases(spark):
    return protect.deidentified(_external(spark), ["id"], "clinical", entities="entities").withColumn("warnings", F.array_join("warnings", "|"))


@case(
    "id clinical strict_privacy", (1, "Contact email: [EMAIL]", "Contact email: [REMOVED]"), (2, "Requesting Physician:\nDr. Sarah Al-Mutairi", "Requesting Physician:\n[REMOVED]"),
    (3, "Reporting Physician: Dr. Huda Khaled", "Reporting Physician: Dr. [REMOVED]"), (4, "Patient Name:\n[PATIENT_NAME]", "Patient Name:\n[REMOVED]"), (5, "call 22345678 today", "call 22345678 today"),
    (6, "Consultant: Dr. Sam Roe\nPatient: [PATIENT_NAME]", "Consultant: [REMOVED]\nPatient: [REMOVED]"), (7, "الطبيب المعالج: د. هدى خالد", "الطبيب المعالج: د. [REMOVED]"), (8, "Phone: [PHONE_NUMBER]", "Phone: [REMOVED]"),
    (9, "The patient record is MRN-[MRN:43fae6c11d]", "The patient record is MRN-[REMOVED]"), (10, None, None), (11, "", ""),
)
def deidentify_cases(spark):
    t = texts(spark, [
        "Contact email: patient@example.com", "Requesting Physician:\nDr. Sarah Al-Mutairi", "Reporting Physician: Dr. Huda Khaled", "Patient Name:\nFatima Abdullah Al-Dosari", "call 22345678 today",
        "Consultant: Dr. Sam Roe\nPatient: Ann Bell", "الطبيب المعالج: د. هدى خالد", "Phone: +96512345678", "The patient record is MRN-123456.", None, "",
    ])
    a, b = (protect.deidentified(t, ["id"], p).select("id", F.col("protected").alias(p)) for p in ("clinical", "strict_privacy"))
    return a.join(b, "id")


@case(
    "id rule kind value start_pos", (1, "context_patient_name", "patient_name", "Fatima Abdullah Al-Dosari", 14), (2, "context_clinician", "physician_name", "Dr. Sarah Al-Mutairi", 22), (3, "context_physician", "physician_name", "Huda Khaled", 25),
    (4, "inline_mrn", "mrn", "MRN-123456", 22), (6, "context_patient_name", "patient_name", "Civil ID: 12", 9), (6, "context_civil_id", "civil_id", "12", 19), (7, "inline_lab_number", "lab_number", "LAB-9", 0), (7, "inline_specimen_number", "specimen_number", "SP 77", 6),
)
def context_rule_cases(spark):
    t = texts(spark, ["Patient Name:\nFatima Abdullah Al-Dosari", "Requesting Physician:\nDr. Sarah Al-Mutairi", "Reporting Physician: Dr. Huda Khaled", "The patient record is MRN-123456.", "Patient: Ann = Bell", "Patient:\nCivil ID: 12", "LAB-9 SP 77 LAB 5"])
    return protect.detected(t, ["id"], rules=[*protect.CONTEXT_RULES, *protect.INLINE_RULES])


@case("id action target", (1, "keep", "physician_name"), (2, "hash", "mrn"), (3, "keep", "organization"), (4, "mask", "unknown"), (5, "keep", "starship"), (6, "replace", "email"))
def policy_target_cases(spark):
    t = texts(spark, ["PHYSICIAN_NAME", " mrn ", "HOSPITAL", "UNKNOWN_PII", "starship", "email"]).withColumn("target", protect.target(F.col("text")))
    return t.select("id", protect.actions("clinical", F.col("target")).alias("action"), "target")


@case("id profile", (1, "clinical"), (2, "research"), (3, "strict_privacy"), (4, "strict_privacy"), (5, None), (6, "clinical"))
def policy_name_cases(spark):
    return texts(spark, ["clinical", "RESEARCH", "strict_privacy", "strict", "none", "mednexus_default"]).select("id", protect.profile_named(F.col("text")).alias("profile"))


@case("profile kind", ("a", "y"), ("b", "y"), ("b", "x"))
def policy_gap_cases(spark):
    """Types without an action, with two or with an unknown one."""
    return protect.unmapped(spark.createDataFrame([("a", "x", "keep"), ("a", "y", "melt"), ("b", "x", "keep"), ("b", "x", "mask")], "profile string, kind string, action string"))


# -- vocabulary

VOCABULARY = [
    terms.row("Doctor", "clinical_occupation", aliases=["Dr.", " dr. ", ""]), terms.row("Clinical Doctor", "clinical_occupation"), terms.row("Biopsy", "procedure", "pathology", ["Diagnosis"], ["Core Biopsy"], ["pathology_report"]),
    terms.row("MRI", "procedure", "radiology", case_sensitive=True), terms.row("Normal study", "finding", "radiology", match_mode="exact"), terms.row("Off", "finding", enabled=False),
]


@case("id found", (1, "Clinical Doctor@4"), (2, "MRI@0|Doctor@11"), (3, "Normal study@0"), (4, ""), (5, "Doctor@0"), (6, ""))
def vocabulary_cases(spark):
    t = texts(spark, ["The clinical doctor", "MRI mri by doctor", "normal study", "normal study, off; doctors", "Dr. Roe", "core biopsy"])
    return t.select("id", listed(terms.matches(F.col("text"), VOCABULARY), lambda x: F.concat_ws("@", x["term"], x["start_pos"])).alias("found"))


@case("id section_and_type section_only type_only specialty", (1, "Biopsy", "", "", ""), (2, "Doctor|Biopsy", "Doctor", "Doctor", "Doctor"), (3, "MRI", "MRI", "MRI", ""))
def vocabulary_filter_cases(spark):
    t = texts(spark, ["core biopsy", "doctor, biopsy, biopsy", "MRI"])
    of = lambda **w: F.array_join(terms.matched_terms(F.col("text"), VOCABULARY, **w), "|")
    return t.select("id", of(section=" diagnosis ", document_type="Pathology_Report").alias("section_and_type"), of(section="diagnosis").alias("section_only"), of(document_type="pathology_report").alias("type_only"), of(specialties=["pathology"]).alias("specialty"))


@case("what n", ("common", 8), ("laboratory", 10), ("pathology", 15), ("in diagnosis of pathology", 23), ("masked there", 11), ("without pathology", 16), ("replaced", 1))
def vocabulary_table_cases(spark):
    v = terms.default_vocabulary(spark)
    in_diagnosis = terms.applying(v, "diagnosis", "pathology_report")
    with_sources = [
        ("common", v.where("size(document_types) = 0")), ("laboratory", v.where("array_contains(document_types, 'laboratory_report')")), ("pathology", v.where("array_contains(document_types, 'pathology_report')")),
        ("in diagnosis of pathology", in_diagnosis), ("masked there", in_diagnosis.where("category not in ('clinical_occupation', 'clinical_specialty')")),
        ("without pathology", terms.unregistered(v, "Pathology")),
        ("replaced", terms.registered(v, spark.createDataFrame([terms.row("Biopsy", "procedure", "pathology")], terms.VOCABULARY)).where("specialty = 'pathology'")),
    ]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in with_sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@case("id term aliases match_mode enabled source", (1, "Liver", "Hepar|jecur", "word", True, "wardloom"), (2, "X", "", "exact", False, "site"))
def vocabulary_contract_cases(spark):
    rows = [(1, " Liver ", ["Hepar", " hepar", "", "jecur"], None, None, " "), (2, "X", None, "EXACT", False, "site"), (3, "  ", None, None, None, None), (4, "Y", None, "fuzzy", None, None), (5, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, term string, aliases array<string>, match_mode string, enabled boolean, source string")
    return terms.normalised(df).withColumn("aliases", F.array_join("aliases", "|")).withColumn("id", F.when(F.col("term") == "Liver", 1).otherwise(2))


@case("id text tokens restored", (1, "Gross Description:\n__CTX_0001__ __CTX_0002__ mass\nDiagnosis\n__CTX_0003__ seen, pathologist", "white|firm|Core Biopsy", "Gross Description:\nwhite firm mass\nDiagnosis\nCore Biopsy seen, pathologist"), (2, "white firm", "", "white firm"), (3, "", "", ""))
def masking_cases(spark):
    t = texts(spark, ["Gross Description:\nwhite firm mass\nDiagnosis\nCore Biopsy seen, pathologist", "white firm", ""]).withColumn("p", terms.protected_by_section(F.col("text")))
    return t.select("id", F.col("p.text").alias("text"), listed(F.col("p.tokens"), lambda x: x["value"]).alias("tokens"), terms.restored(F.col("p.text"), F.col("p.tokens")).alias("restored"))


@case("id present lines", (1, "patient_information|diagnosis", "|patient_information|patient_information|diagnosis|diagnosis"), (2, "", ""))
def heading_cases(spark):
    t = texts(spark, ["Title\nPatient Name:\nAnn\n  FINAL   diagnosis:\nx", "none"])
    return t.select("id", F.array_join(terms.sections_present(F.col("text")), "|").alias("present"), F.array_join(F.transform(terms.line_sections(F.col("text")), lambda x: F.coalesce(x["section"], F.lit(""))), "|").alias("lines"))


# -- understanding


@case("id language", (1, "ENGLISH"), (2, "ARABIC"), (3, "MIXED"), (4, "UNKNOWN"), (5, "ENGLISH"), (6, "ARABIC"))
def language_cases(spark):
    t = texts(spark, [
        "Clinical report findings and impression", "تقرير طبي عن حالة المريض", "Clinical report findings\nتقرير طبي عن حالة المريض", "123", "A long English report on the findings of the study with one word مرحبا", "تقرير طويل عن حالة المريض ونتائج الفحص والتشخيص CT",
    ])
    return t.select("id", understand.script_language(F.col("text")).alias("language"))


@case(
    "id sections", (1, "history_of_present_illness 7-30|findings 30-46"), (2, "findings 19-33|findings 33-45"), (3, "procedure_information 0-38|technique 38-55|comparison 55-72|findings 72-85|impression 85-101"),
    (4, "procedure_information 0-37|technique 37-53|comparison 53-69|findings 69-81|impression 81-96"), (5, ""), (6, "examination 0-39"), (7, ""),
)
def section_cases(spark):
    t = texts(spark, [
        "Header\nHPI:\nPain for two days\nFINDINGS: Normal", "prose on Findings\r\nFINDINGS:\r\nx\r\nFINDINGS:\r\ny", "Procedure Information: MRI of abdomen Technique: axial Comparison: none Findings: ok Impression: fine",
        "Procedure Information MRI of abdomen Technique axial Comparison none Findings ok Impression fine", "The patient has Findings and an Impression of calm", "Examination: CT rib\nIMPRESSION - ok? :x", "",
    ])
    return t.select("id", listed(understand.sections_of(F.col("text")), lambda x: F.concat_ws(" ", x["canonical_name"], F.concat_ws("-", x["start_pos"], x["end_pos"]))).alias("sections"))


_ABDOMEN = "MRI ABDOMEN AND PELVIS\nProcedure Information: MRI of the abdomen and pelvis, pre- and post-contrast, cancer staging\nTechnique: Axial T1, T2, DWI, STIR and fat suppressed images\nFindings: no lesion\nImpression: normal\nRadiologist: Dr. A"
_ARABIC_CT = "تقرير الأشعة\nالفحص: أشعة مقطعية على الصدر بالصبغة\nالطريقة: مقاطع\nالنتائج: سليمة\nالانطباع: طبيعي\nطبيب الأشعة: د. أ"


@case("id modality examination region regions contrast techniques purpose", (1, "MRI", "MRI Abdomen & Pelvis", "ABDOMEN", "ABDOMEN|PELVIS", "PRE_AND_POST_CONTRAST", "T1-weighted imaging|T2-weighted imaging|STIR imaging|Diffusion-weighted imaging|Fat-suppressed imaging|Multiplanar imaging", "Oncologic Staging"), (2, "CT", "CT Chest", "CHEST", "CHEST", "WITH_CONTRAST", "", None), (3, None, None, None, None, None, None, None))
def context_cases(spark):
    made = understand.contexts(texts(spark, [_ABDOMEN, _ARABIC_CT, "nothing"]), "id").select("id", "clinical.*")
    return made.withColumn("regions", F.array_join("regions", "|")).withColumn("techniques", F.array_join("techniques", "|"))


@case("id modality", (1, "CT"), (2, "MRI"), (3, "X_RAY"), (4, "ULTRASOUND"), (5, "DOPPLER"), (6, "MAMMOGRAPHY"), (7, "NUCLEAR_MEDICINE"), (8, "UNKNOWN"), (9, "MRI"), (10, "UNKNOWN"))
def modality_cases(spark):
    t = texts(spark, ["CT chest", "MRI brain", "Chest x-ray", "Abdominal ultrasound", "Doppler ultrasound of the leg", "Screening mammogram", "PET scan", "CT and MRI", "axial T1 and T2 images", "ACTS"])
    none = F.array().cast(f"array<{understand.SECTION}>")
    return t.select("id", radiology.modality(radiology.own_signals(F.col("text"), none)).alias("modality"))


@case("id domain report score nature signed", (1, True, True, 28.3, "COMPLETED_REPORT", True), (2, False, False, 3.0, "UNKNOWN", False), (3, True, False, 13.5, "STRUCTURED_TEMPLATE", False), (4, False, False, 0.0, "UNKNOWN", False))
def radiology_gate_cases(spark):
    t = texts(spark, [_ABDOMEN, "MRI head", "Examination: CT or MRI\nTechnique: as asked\nComparison: none\nImpression: x\nradiologist", "weather"])
    s, g = F.col("s"), F.col("g")
    t = t.withColumn("s", understand.sections_of(F.col("text"))).withColumn("g", radiology.own_signals(F.col("text"), F.col("s")))
    return t.select("id", radiology.domain_satisfied(g).alias("domain"), radiology.report_satisfied(g).alias("report"), radiology.score(g).alias("score"), radiology.nature(g, s).alias("nature"), radiology.signed(g).alias("signed"))


@case("id family concept_id value start_pos context", (1, "modality", "RAD_MODALITY_CT", "ct", 4, "the ct of chest"), (1, "anatomy", "RAD_ANAT_CHEST", "chest", 10, "the ct of chest"), (1, "structure", "RAD_SECTION_FINDINGS", "Findings", 16, "Findings: clear"))
def signal_cases(spark):
    t = texts(spark, ["the ct of chest\nFindings: clear"]).withColumn("s", understand.sections_of(F.col("text")))
    return t.select("id", F.inline(radiology.own_signals(F.col("text"), F.col("s"))))


@case("family concept_id strength provenance relationships", ("modality", "RAD_MODALITY_CT", 2.0, "LOINC", "IS_A X1"), ("anatomy", "X2", 0.75, "RADLEX", ""), ("modality", "RAD_MODALITY_CT", 2.0, "", ""))
def imported_signal_cases(spark):
    """Imported concepts enrich a signal of the same span, or add one; short ones and other families don't count."""
    t = texts(spark, ["CT of liver, CT"])
    none = F.array().cast(f"array<{understand.SECTION}>")
    row = lambda c, f, s, e, v, src, rel: f"named_struct('concept_id', '{c}', 'concept_family', '{f}', 'start_pos', {s}, 'end_pos', {e}, 'found', '{v}', 'provenance', array('{src}'), 'mappings', array(named_struct('source_id', '{src}', 'external_id', 'e')), 'relationships', {rel})"
    edge, no_edge = "array(named_struct('type', 'IS_A', 'target', 'X1'))", "cast(array() as array<struct<type:string,target:string>>)"
    imported = F.expr(f"array({row('X1', 'IMAGING_MODALITY', 0, 2, 'CT ', 'LOINC', edge)}, {row('X2', 'BODY_REGION', 6, 11, 'liver', 'RADLEX', no_edge)}, {row('X3', 'BODY_REGION', 6, 11, 'li', 'RADLEX', no_edge)}, {row('X4', 'LATERALITY', 6, 11, 'liver', 'RADLEX', no_edge)})")
    made = t.select(F.inline(radiology.with_imported(radiology.own_signals(F.col("text"), none), imported, F.col("text"))))
    return made.select("family", "concept_id", "strength", F.array_join("provenance", "|").alias("provenance"), listed(F.col("relationships"), lambda r: F.concat_ws(" ", r["type"], r["target"])).alias("relationships"))


@case("concept_id score", ("X2", 1.0))
def relationship_bonus_cases(spark):
    """A quarter of a point for each relationship between concepts that both stand in a text."""
    s = "named_struct('family', 'anatomy', 'concept_id', '{}', 'value', 'v', 'start_pos', 0, 'end_pos', 1, 'strength', 0.0D, 'context', '', 'provenance', cast(array() as array<string>), 'mappings', cast(array() as array<struct<source_id:string,external_id:string>>), 'relationships', array({}))"
    edge = lambda *ts: ", ".join(f"named_struct('type', 'IS_A', 'target', '{t}')" for t in ts)
    g = F.expr(f"array({s.format('X1', edge('X2', 'X3', 'X2', 'X9'))}, {s.format('X2', edge('X1'))}, {s.format('X3', edge('X1'))})")
    return texts(spark, ["x"]).select(F.lit("X2").alias("concept_id"), radiology.score(g).alias("score"))


@case(
    "id document_type confidence_band subtype", (1, "radiology_report", "HIGH", "CT"), (2, "pathology_report", "HIGH", "UNKNOWN"), (3, "laboratory_report", "HIGH", "UNKNOWN"), (4, "emergency_report", "HIGH", "UNKNOWN"), (5, "admission_note", "HIGH", "UNKNOWN"),
    (6, "discharge_summary", "HIGH", "UNKNOWN"), (7, "public_health_document", "MEDIUM", "UNKNOWN"), (8, "unknown", "LOW", "UNKNOWN"), (9, "unknown", "UNKNOWN", "UNKNOWN"), (10, "discharge_summary", "MEDIUM", "UNKNOWN"), (11, "unknown", "LOW", "UNKNOWN"),
)
def classification_cases(spark):
    t = texts(spark, [
        "RADIOLOGY REPORT\nExamination: CT chest with contrast\nTechnique: axial\nFindings: clear\nImpression: normal", "PATHOLOGY REPORT\nSpecimen: skin\nGross Description: x\nMicroscopic Description: y\nFinal Diagnosis: z\nImmunohistochemistry done",
        "LABORATORY REPORT\nTest result, units, reference range, validated", "EMERGENCY DEPARTMENT\nChief Complaint: pain\nTriage: 2\nVital Signs: ok\nDisposition: home", "ADMISSION NOTE\nAdmission Diagnosis: x\nreason for admission\nملاحظة الدخول",
        "DISCHARGE SUMMARY\nHospital Course: x\nDischarge Diagnosis: y\nDischarge Medications: z", "PUBLIC HEALTH NOTIFICATION\nsurveillance report", "RADIOLOGY REPORT\nPATHOLOGY REPORT", "the weather",
        "DISCHARGE SUMMARY\nHospital Course: MRI of brain done. Findings: x Impression: y\nDischarge Diagnosis: z\nDischarge Medications: w\nFollow-up: MRI brain T1 T2", "laboratory report",
    ])
    return understand.classified(t, "id")


@case("id extraction terminology capabilities manual_review", (1, "radiology_extraction", "radiology_terminology", "PROTECT|EXTRACT|STANDARDIZE", False), (2, "discharge_extraction", "general_clinical_terminology", "PROTECT|EXTRACT|STANDARDIZE", False), (3, "manual_review", "general_clinical_terminology", "PROTECT", True), (4, "manual_review", "general_clinical_terminology", "PROTECT", True), (5, "manual_review", "general_clinical_terminology", "PROTECT", True))
def routing_cases(spark):
    df = spark.createDataFrame([(1, "radiology_report", "HIGH"), (2, "discharge_summary", "MEDIUM"), (3, "radiology_report", "LOW"), (4, "unknown", "HIGH"), (5, None, None)], "id int, kind string, band string")
    return df.select("id", understand.routing(F.col("kind"), F.col("band")).alias("r")).select("id", "r.*").withColumn("capabilities", F.array_join("capabilities", "|"))


@case("section role privacy", ("patient_information", "Patient / Administrative Information", "likely_identifier_bearing"), ("follow_up", "Follow Up", None), ("authorization", "Authorization", "provider_authentication"), ("technique", "Technique", None))
def section_role_cases(spark):
    t = spark.createDataFrame([("patient_information",), ("follow_up",), ("authorization",), ("technique",)], "section string")
    return t.select("section", radiology.semantic_role(F.col("section")).alias("role"), radiology.privacy_role(F.col("section")).alias("privacy"))


# -- terms and concepts


@case("id key", (1, "t1 weighted"), (2, "c section"), (3, "strasse"), (4, "fi mri"), (5, "الصدر"), (6, ""), (7, "abc 12"), (8, "σασ"))
def term_key_cases(spark):
    return texts(spark, ["  T1–WEIGHTED  ", "C-Section", "Straße", "ﬁ (MRI)", "الصدر", "--", "ＡＢＣ　１２", "ΣΑΣ"]).select("id", concepts.term_key(F.col("text")).alias("key"))


def _model(spark):
    rows = [
        ("c1", "C-section", "procedure", ["caesarean section"], "A"), ("c2", "Section", "procedure", [], "A"), ("c3", "Left lower lobe of lung", "anatomy", ["left lower lobe"], "B"), ("c4", "C Section", "procedure", ["c/s"], "B"), ("c5", "Section", "anatomy", [], "B"),
    ]
    df = spark.createDataFrame(rows, "concept_id string, canonical_name string, concept_family string, synonyms array<string>, source string")
    return df.withColumn("domain", F.lit("d")).withColumn("preferred_terms", F.array("canonical_name")).withColumn("languages", F.array(F.lit("en"))).withColumn("status", F.lit("ACTIVE"))


_SPANS = [("c1", "C-section", 2), ("c2", "section", 4), ("c4", "C-section", 2), ("c5", "section", 4), ("c3", "Left  lower\nlobe", 13), ("c3", "left lower lobe of lung", 35), ("c3", "left lower lobe", 35)]


@case("concept_id found start_pos", *[(c, " ".join(f.replace("-", " ").split()), s) for c, f, s in _SPANS])
def concept_span_cases(spark):
    """Terms meet texts whatever their signs, case and blanks; nested spans are all kept, and both ways to join give the same."""
    t = texts(spark, ["A C-section. Left  lower\nlobe; the left lower lobe of lung"]).withColumnRenamed("id", "doc_id")
    model = concepts.terms_of(_model(spark))
    few, many = concepts.resolved(t, model), concepts.resolved(t, model, small=0)
    return few.intersect(many).unionByName(few.exceptAll(many)).unionByName(many.exceptAll(few)).select("concept_id", "found", "start_pos")


@case("term concept_id", ("c SECTION", "c1"), ("c SECTION", "c4"), ("none", None))
def term_resolution_cases(spark):
    return concepts.resolved_terms(spark.createDataFrame([("c SECTION",), ("none",)], "term string"), concepts.terms_of(_model(spark)))


@case("term concept_id", ("section", "c5"))
def term_filter_cases(spark):
    """Terms resolved among the concepts of one family."""
    return concepts.resolved_terms(spark.createDataFrame([("section",)], "term string"), concepts.terms_of(_model(spark).where("concept_family = 'anatomy'")))


@case("concept_id name terms", ("c1", "c section", "C-section|C Section|caesarean section|c/s"), ("c2", "section", "Section"), ("c3", "left lower lobe of lung", "Left lower lobe of lung|left lower lobe"), ("c5", "section", "Section"))
def concept_merge_cases(spark):
    return concepts.merged(_model(spark)).select("concept_id", "name", F.array_join(F.concat("preferred_terms", "synonyms"), "|").alias("terms"))


@case("concept_id kept_id", ("c4", "c1"))
def crosswalk_cases(spark):
    return concepts.crosswalk(_model(spark))


@case("child ancestor depth", ("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2), ("d", "b", 2), ("d", "c", 3))
def ancestor_cases(spark):
    """A circle and what hangs on it."""
    return concepts.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "a")], "child string, parent string"))


@case("version change", ("a", "changed"), ("b", "removed"), ("d", "added"))
def version_cases(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "version string, n string"), spark.createDataFrame([("a", "2"), ("c", "1"), ("d", "1")], "version string, n string")
    return concepts.differences(old, new, "version", "n")


@case("label near gap", ("chest", "CT", 4), ("liver", "MRI", 0))
def nearest_cases(spark):
    a = spark.createDataFrame([(1, 10, 15, "chest"), (1, 40, 45, "liver"), (1, 400, 404, "head")], "doc_id int, start_pos int, end_pos int, label string")
    b = spark.createDataFrame([(1, 4, 6, "CT"), (1, 42, 45, "MRI"), (2, 10, 15, "US")], "doc_id int, start_pos int, end_pos int, label string")
    return terms.nearest(a, b, "doc_id")


# -- importers

PLAYBOOK = "LoincNumber,LongCommonName,PartNumber,PartTypeName,PartName,PartSequenceOrder,RID,PreferredName,RPID,LongName\n1-1,CT Chest,LP1,Modality,CT,1,RID10,computed tomography,RPID5,CT CHEST\n1-1,CT Chest,LP2,Region Imaged,Chest,2,,,,\n"
LOINC_FILES = {
    "LoincRsnaRadiologyPlaybook.csv": PLAYBOOK, "Part.csv": "PartNumber,PartTypeName,PartName,PartDisplayName,Status\nLP1,MODALITY,Computed Tomography,CT scan,ACTIVE\nLP3,ROLE,Radiologist,,DEPRECATED\n",
    "PartRelatedCodeMapping.csv": "PartNumber,ExtCodeId,ExtCodeDisplayName,ExtCodeSystem,Equivalence\nLP1,RID28840,computed tomography,http://www.radlex.org,equivalent\nLP2,51185008,Chest,http://snomed.info/sct,\nLP2,X,Chest,http://other.org,\n",
    "DocumentOntology.csv": "LoincNumber,PartNumber,PartTypeName,PartSequenceOrder,PartName\n2-2,LP3,Document.Role,1,Radiologist\n", "ImagingDocuments.csv": "LOINC_NUM,LONG_COMMON_NAME\n2-2,Radiology note\n3-3,CT study\n",
    "Loinc.csv": "LOINC_NUM,LONG_COMMON_NAME\n2-2,Note of radiology\n",
}


@case(
    "canonical_name concept_family mappings relationships synonyms status", ("CT Chest", "IMAGING_PROCEDURE", "1-1|RID10|RPID5", "1:MODALITY:LP1|2:REGION_IMAGED:LP2", "", "ACTIVE"), ("Computed Tomography", "IMAGING_MODALITY", "LP1|RID28840|RID10", "", "CT scan|CT", "ACTIVE"),
    ("Chest", "BODY_REGION", "LP2|X|51185008", "", "", "ACTIVE"), ("Radiologist", "PROCEDURE_ATTRIBUTE", "LP3", "", "", "DEPRECATED"), ("Radiology note", "DOCUMENT_REPORT", "2-2", "1:DOCUMENT_ROLE:LP3", "", "ACTIVE"), ("CT study", "DOCUMENT_REPORT", "3-3", "", "", "ACTIVE"),
)
def playbook_cases(spark):
    made = terminology.imported(spark, "LOINC_RSNA_PLAYBOOK", put(spark, "case-playbook", LOINC_FILES))
    return made.select(
        "canonical_name", "concept_family", listed(F.col("mappings"), lambda m: m["external_id"]).alias("mappings"), listed(F.col("relationships"), lambda r: F.concat_ws(":", r["sequence_order"], r["source_relationship"], r["external_id"])).alias("relationships"),
        F.array_join("synonyms", "|").alias("synonyms"), "status",
    )


@case("problem value n", ("unknown mapping source", "LOINC_RELATED:http://other.org", 1), ("unknown mapping source", "RADLEX_CURRENT", 4))
def integrity_cases(spark):
    made = terminology.loinc(spark, put(spark, "case-playbook-2", LOINC_FILES))
    return concepts.integrity(made, spark.createDataFrame([("LOINC_RSNA",), (terminology.SNOMED,)], "source_id string"))


@case("facet value n", ("total", "concepts", 6), ("total", "preferred_terms", 6), ("total", "synonyms", 2), ("total", "mappings", 12), ("total", "relationships", 3), ("total", "context_groups", 0), ("source", "LOINC_RSNA", 6), ("family", "IMAGING_PROCEDURE", 1), ("family", "IMAGING_MODALITY", 1), ("family", "BODY_REGION", 1), ("family", "PROCEDURE_ATTRIBUTE", 1), ("family", "DOCUMENT_REPORT", 2), ("record_type", "RADIOLOGY_PROCEDURE", 1), ("record_type", "LOINC_PART", 3), ("record_type", "IMAGING_DOCUMENT", 2), ("mapping_source", "LOINC_RSNA", 6), ("mapping_source", "RADLEX_CURRENT", 4), ("mapping_source", "SNOMED_INT_20260701", 1), ("mapping_source", "LOINC_RELATED:http://other.org", 1), ("relationship", "CAN_COMPOSE", 3))
def coverage_cases(spark):
    return concepts.coverage_report(terminology.loinc(spark, put(spark, "case-playbook-3", LOINC_FILES)))


RADLEX_FILES = {
    "Radlex.csv": "Class ID,Preferred Label,Synonyms,Definitions,Obsolete,Semantic Types,Parents\nhttp://r/RID1,anatomical entity,,,FALSE,,\nhttp://r/RID2,lung,pulmo|Lunge;lung,organ,FALSE,,http://r/RID1\nhttp://r/RID3,old,,,TRUE,,\nhttp://r/RID4,stray,,,FALSE,imaging observation,http://r/RID9\nhttp://r/RID5,lobe,,,FALSE,,http://r/RID2\n",
    "RadLex.owl": "<owl:Class rdf:about='http://r/RID1'/>\n<owl:Class rdf:about='http://r/RID2'/> RID5\n",
}


@case("canonical_name concept_family synonyms parents", ("anatomical entity", "BODY_REGION", "", ""), ("lung", "BODY_REGION", "pulmo|Lunge", "RID1"), ("lobe", "BODY_REGION", "", "RID2"))
def lexicon_cases(spark):
    """Obsolete classes and those that the ontology lacks are left out; a class takes its family from its ancestors too. The artifact is an archive."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for n, c in RADLEX_FILES.items():
            z.writestr(n, c)
    made = terminology.imported(spark, "RADLEX", put(spark, "case-lexicon", {"radlex.zip": packed.getvalue()}))
    return made.select("canonical_name", "concept_family", F.array_join("synonyms", "|").alias("synonyms"), listed(F.col("relationships"), lambda r: r["external_id"]).alias("parents"))


def _tr(*cells: str) -> str:
    return "<tr>" + "".join(f"<td><para>{c}</para></td>" for c in cells) + "</tr>"


DCMR = (
    "<book><section xml:id='sect_CID_29'><title>Acquisition Modality</title><table><tbody>" + _tr("Coding Scheme Designator", "Code Value", "Code Meaning") + _tr("DCM", "CT", "Computed Tomography") + _tr("SCT", "1", "Other") + _tr("DCM", "", "none")
    + "</tbody></table></section><section xml:id='sect_CID_5'><title>Elsewhere</title><table><tbody>" + _tr("DCM", "X", "Y") + "</tbody></table></section></book>"
)


@case("canonical_name concept_family record_type mapping_sources member_of", ("Acquisition Modality", "IMAGING_MODALITY", "DCMR_CONTEXT_GROUP", "DICOM_DCMR", ""), ("Computed Tomography", "IMAGING_MODALITY", "DCMR_CODE", "DICOM_DCMR|DICOM_DCMR", "CID:29"), ("Other", "IMAGING_MODALITY", "DCMR_CODE", "SNOMED_INT_20260701|DICOM_DCMR", "CID:29"))
def context_group_cases(spark):
    made = terminology.imported(spark, "DICOM_DCMR", put(spark, "case-dcmr", {"part16.xml": DCMR}) + "/part16.xml")
    return made.select("canonical_name", "concept_family", F.col("attributes")["record_type"].alias("record_type"), listed(F.col("mappings"), lambda m: m["source_id"]).alias("mapping_sources"), listed(F.col("relationships"), lambda r: r["external_id"]).alias("member_of"))


PART6 = "<book><table><tbody>" + _tr("(0008,0060)", "Modality", "Mod​ality", "CS", "1") + _tr("(0018,0015)", "Body Part Examined", "BodyPartExamined", "CS", "1") + _tr("(0010,0010)", "Patient's Name", "PatientName", "PN", "1") + _tr("x", "y") + "</tbody></table></book>"


@case("canonical_name concept_family code vr", ("Modality", "ACQUISITION", "(0008,0060)", "CS"), ("Body Part Examined", "BODY_REGION", "(0018,0015)", "CS"))
def attribute_cases(spark):
    made = terminology.imported(spark, "DICOM", put(spark, "case-dicom", {"part06.xml": PART6}) + "/part06.xml")
    return made.select("canonical_name", "concept_family", F.col("mappings")[0]["external_id"].alias("code"), F.col("attributes")["vr"].alias("vr"))


RF2 = "id\teffectiveTime\tactive\tmoduleId\tconceptId\tlanguageCode\ttypeId\tterm\tcaseSignificanceId\n1\t2024\t1\tm\t100\ten\t900000000000003001\tLung structure (body structure)\tx\n2\t2024\t1\tm\t100\ten\t900000000000013009\tLung\tx\n3\t2024\t0\tm\t100\ten\t900000000000013009\tOld\tx\n4\t2024\t1\tm\t200\ten\t900000000000003001\tElse\tx\n5\t2024\t1\tm\t300\ten\t900000000000013009\tNameless\tx\n"


@case("canonical_name synonyms code", ("Lung structure (body structure)", "Lung", "100"))
def release_format_cases(spark):
    subset = spark.createDataFrame([("100",), (" 300 ",)], "concept_id string")
    made = terminology.imported(spark, "SNOMED_CT", put(spark, "case-rf2", {"sct2_Description_Snapshot-en.txt": RF2}), subset=subset)
    return made.select("canonical_name", F.array_join("synonyms", "|").alias("synonyms"), F.col("mappings")[0]["external_id"].alias("code"))


MANIFEST = '{"sources": [{"source_id": "A", "version": "1", "distribution_policy": "EXTERNAL_DOWNLOAD_REQUIRED"}, {"source_id": "B", "version": "2", "distribution_policy": "LICENSE_RESTRICTED"}, {"source_id": "C", "version": "3", "distribution_policy": "EXTERNAL_DOWNLOAD_REQUIRED"}, {"source_id": "OWN", "version": "9", "distribution_policy": "BUNDLED"}]}'


@case("source_id status active_version concepts mappings", ("A", "ACTIVE", "1.1", 7, 9), ("B", "LICENSED ARTIFACT REQUIRED", None, 0, 0), ("C", "MISSING ARTIFACT", None, 0, 0), ("OWN", "ACTIVE", "9", 0, 0))
def source_status_cases(spark):
    sources = terminology.manifest(spark, put(spark, "case-manifest", {"manifest.json": MANIFEST}) + "/manifest.json")
    kept = spark.createDataFrame([("A", "1.1", 7, 9), ("A", "1.0", 1, 1)], "source_id string, version string, concept_count long, mapping_count long")
    active = terminology.activated(spark.createDataFrame([("A", "1.0")], "source_id string, version string"), kept, "A", "1.1")
    return terminology.status(sources, active, kept, curated="OWN")


@case("configuration", ('{"A":"1.1","B":"2"}',))
def snapshot_cases(spark):
    return terminology.snapshot(spark.createDataFrame([("B", "2"), ("A", "1.1")], "source_id string, version string"))


@case("n files changed", (2, 2, 1))
def receipt_cases(spark):
    """Files whose digest isn't that of their receipt."""
    root = put(spark, "case-receipts", {"a.txt": "one", "b.txt": "two"})
    now = terminology.receipts(spark, root)
    was = now.withColumn("sha256", F.when(F.col("path").endswith("b.txt"), F.lit("0")).otherwise(F.col("sha256")))
    digest = terminology.directory_digest(now, root).where("length(sha256) = 64")
    return now.agg(F.count("*").alias("n")).crossJoin(was.agg(F.count("*").alias("files"))).crossJoin(terminology.unverified(was, now).agg(F.count("*").alias("changed"))).join(digest, F.lit(True))  # single rows


# -- files


def _docx() -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p('First')}<w:tbl>{row('a', 'b')}{row('', '')}{row('c', 'd')}</w:tbl>{p('Last')}</w:body></w:document>")
        for n in (1, 2):
            z.writestr(f"word/header{n}.xml", f"<w:hdr {ns}>{p('Head')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {ns}>{p('Foot')}</w:ftr>")
        z.writestr("word/media/image1.png", b"x")
    return packed.getvalue()


@case(
    "file_name text encoding problem", ("bom.txt", "heading", "utf-8-sig", None), ("broken.docx", None, None, "BadZipFile"), ("latin.txt", "café", "cp1252", None), ("lines.txt", "a\nb", "utf-8", None), ("noend", None, None, "no extension"),
    ("report.docx", "First\n\na\tb\nc\td\n\nLast\n\nHead\n\nFoot", None, None), ("table.csv", None, None, "unsupported extension .csv"), ("own.dat", "DAT", None, None), ("blank.txt", " \n \n", "utf-8", None),
)
def file_cases(spark):
    root = put(spark, "case-files", {
        "bom.txt": b"\xef\xbb\xbfheading", "broken.docx": b"not a zip", "latin.txt": "café".encode("cp1252"), "lines.txt": b"a\r\nb", "noend": b"x", "report.docx": _docx(), "table.csv": b"a,b", "own.dat": b"dat", "blank.txt": b" \n \n",
    })
    readers = files.Extractors()
    readers.register("dat", lambda content: (content.decode().upper(), None, None, {}, []))
    return files.documents(spark, root, readers).select("file_name", "text", "encoding", F.regexp_extract(F.col("error"), r"^(BadZipFile|.*)", 1).alias("e")).withColumn("problem", F.when(F.col("e").startswith("BadZipFile"), "BadZipFile").otherwise(F.col("e")))


@case("file_name reason", ("blank.txt", "empty document"), ("x.csv", "unsupported extension .csv"))
def quarantine_cases(spark):
    root = put(spark, "case-quarantine", {"blank.txt": b" \n \r\n", "x.csv": b"1", "good.txt": b"good"})
    return files.quarantined(files.documents(spark, root))[1].withColumn("file_name", F.element_at(F.split("path", "/"), -1))


@case("file_name warnings paragraphs tables images", ("report.docx", "1 images are not read", "2", "1", "1"))
def docx_cases(spark):
    m = F.col("metadata")
    d = files.documents(spark, put(spark, "case-docx", {"report.docx": _docx()}))
    return d.select("file_name", F.array_join("warnings", "|").alias("warnings"), m["paragraphs"].alias("paragraphs"), m["tables"].alias("tables"), m["images"].alias("images"))


@case("id extension size page_count line_count is_empty has_warnings encoding warnings", (1, ".txt", 5, 1, 2, False, True, "utf-8", "w"), (2, ".pdf", -1, -1, 0, True, False, None, ""))
def document_contract_cases(spark):
    rows = [(1, " A.TXT ", "TXT", 5, "a\nb\n", " UTF-8 ", 1, {"k": "v"}, [" w ", " "]), (2, "b", ".Pdf", -1, "", " ", -2, {}, [])]
    df = spark.createDataFrame(rows, "id int, file_name string, extension string, size bigint, text string, encoding string, page_count int, metadata map<string,string>, warnings array<string>").withColumn("path", F.col("id").cast("string")).withColumn("error", F.lit(None).cast("string"))
    return files.contract(df).withColumn("id", F.col("path").cast("int")).withColumn("size", F.coalesce("size", F.lit(-1))).withColumn("page_count", F.coalesce("page_count", F.lit(-1))).withColumn("warnings", F.array_join("warnings", "|"))


@case("id problem", (1, None), (2, "no path"), (3, "no extension"), (4, "unsupported extension .csv"), (5, None), (6, "no path"))
def path_cases(spark):
    return files.paths_checked(texts(spark, ["/a/b.TXT", " ", "/a.b/c", "x.csv", "y.Docx", None]), "text")


@case("id file_name size error", (1, "pasted-text.txt", 5, None), (2, "pasted-text.txt", 2, "empty document"), (3, "pasted-text.txt", -1, "empty document"))
def pasted_cases(spark):
    t = texts(spark, ["café", "\n ", None])
    return files.pasted(t).withColumn("size", F.coalesce("size", F.lit(-1))).withColumn("id", F.when(F.col("size") == 5, 1).when(F.col("size") == 2, 2).otherwise(3))


@case("id n", (1, 0), (2, 1), (3, 2), (4, 3), (5, 2), (6, 1))
def line_count_cases(spark):
    return texts(spark, ["", "a", "a\nb\n", "a\r\nb\rc", "a b", "\n"]).select("id", scalars.line_count(F.col("text")).alias("n"))


# -- older ways, streams


@case("id done", (1, "[MRN:6b86b273ff] of Ann"), (2, "[PATIENT_NAME] Bell, Ann"), (3, "Ann Bell"), (4, "[PATIENT_NAME] is here"), (5, "Ann"), (6, "[EMAIL] and a@b.com"))
def entity_transform_cases(spark):
    rows = [
        (1, "1 of Ann", [("mrn", "1", 0, 1), ("mrn", "1", 0, 1)]), (2, "Ann Bell, Ann", [("PATIENT_NAME", "Ann", 99, 102)]), (3, "Ann Bell", [("physician_name", "Ann", 0, 3)]), (4, "Ann Bell is here", [("patient_name", "Ann", 0, 3), ("patient_name", "Ann Bell", 0, 8)]),
        (5, "Ann", [(None, "Ann", 0, 3), ("patient_name", "", 0, 0)]), (6, "a@b.com and a@b.com", [("email", "a@b.com", None, None)]),
    ]
    df = spark.createDataFrame(rows, "id int, text string, e array<struct<entity:string,value:string,start:int,end:int>>")
    return df.select("id", compat.by_entities(F.col("text"), F.col("e"), "clinical").alias("done"))


@case("id done", (1, "Patient Name: [PATIENT_NAME]\nPhysician: Dr. Roe\nEmail: [EMAIL]"), (2, "DOB: 1/1/2000, Address: [ADDRESS]"), (3, ""), (4, "nothing"))
def label_transform_cases(spark):
    t = texts(spark, ["Patient Name: Ann Bell\nPhysician: Dr. Roe\nEmail: a@b.com", "DOB: 1/1/2000, Address: Hill 5", "", "nothing"])
    return t.select("id", compat.transformed_text(F.col("text"), F.array().cast("array<struct<entity:string,value:string,start:int,end:int>>"), "clinical").alias("done"))


@case("id text tokens restored", (1, "__KEEP_0001__ of __KEEP_0002__\n__KEEP_0003__", "Dr. Sam Roe Hill|City Hospital|Radiology Department", "Dr. Sam Roe Hill of City Hospital\nRadiology Department"), (2, "__KEEP_0001__", "Reporting Physician", "Reporting Physician"))
def kept_cases(spark):
    t = texts(spark, ["Dr. Sam Roe Hill of City Hospital\nRadiology Department", "Reporting Physician"]).withColumn("p", compat.kept_protected(F.col("text"), "clinical"))
    return t.select("id", F.col("p.text").alias("text"), listed(F.col("p.tokens"), lambda x: x["value"]).alias("tokens"), compat.restored(F.col("p.text"), F.col("p.tokens")).alias("restored"))


@case("id text restored", (1, "id __PLACEHOLDER_0001__ and __PLACEHOLDER_0002__ [x]", "id [MRN:6f82d913ab] and [EMAIL] [x]"))
def placeholder_cases(spark):
    t = texts(spark, ["id [MRN:6f82d913ab] and [EMAIL] [x]"]).withColumn("p", compat.placeholders_protected(F.col("text")))
    return t.select("id", F.col("p.text").alias("text"), compat.restored(F.col("p.text"), F.col("p.tokens")).alias("restored"))


@case("id touched v", (3, 30, "c"), (1, 40, "z"))
def retained_cases(spark):
    """The rows touched last, one a key."""
    df = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "c"), (1, 40, "z")], "id int, touched int, v string")
    return stream.latest(df, "id", "touched", 2)
