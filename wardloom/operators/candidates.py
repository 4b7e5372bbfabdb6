"""Candidates of personal spans as arrays in their document's row: gathered, typed, given roles, decided and settled without a shuffle.

A candidate is a struct; ``FIELDS`` names its fields. All functions take and return columns, so they run in batches and streams alike.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from wardloom.functions.scalars import bound, digits_folded, lookup, text_lines
from wardloom.operators.spans import located

FIELDS = {
    "seq": "int", "rule": "string", "source": "string", "label": "string", "other_label": "string", "kind": "string", "start_pos": "int", "end_pos": "int", "value": "string",
    "confidence": "double", "decision": "string", "reason": "string",
}
CANDIDATE = f"struct<{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>"

# Labels of recognisers and fields, by the type that they mean.
LABELS = {
    "person_name": "name person person_name full_name firstname first_name given_name lastname last_name surname family_name middle_name username user_name",
    "patient_name": "patient patient_name", "physician_name": "doctor doctor_name physician physician_name clinician consultant_name provider_name", "nurse_name": "nurse nurse_name",
    "guardian_name": "guardian guardian_name", "relative_name": "relative relative_name next_of_kin", "employee_name": "employee_name", "student_name": "student_name",
    "civil_id": "civil_id civil_number national_id national_identifier government_id identity_number",
    "mrn": "mrn medical_record_number medical_record_no medical_record_id patient_id",
    "visit_number": "visit_number visit_id encounter_number encounter_id episode_number", "accession_number": "accession_number accession_id",
    "specimen_number": "specimen_number specimen_id", "lab_number": "lab_number laboratory_number laboratory_id", "document_id": "document_id document_number record_checksum",
    "insurance_number": "insurance_number insurance_id policy_number", "employee_number": "employee_number employee_id", "student_number": "student_number student_id",
    "phone_number": "phone phone_number telephone telephone_number mobile mobile_number fax", "email": "email email_address e_mail",
    "address": "address street_address postal_address home_address", "date_of_birth": "date_of_birth dob birth_date", "admission_date": "admission_date admit_date",
    "discharge_date": "discharge_date", "collection_date": "collection_date collection_time specimen_collection_date", "exam_date": "exam_date examination_date study_date order_date",
    "general_date": "date datetime date_time", "organization": "organization organisation hospital facility company", "location": "location place city country geographic_location",
    "professional_role": "occupation job_title profession professional_role",
    "unknown": "bic iban swift credit_card credit_card_number cryptocurrency_address ip_address url license_plate",
}
KIND_OF = {label: kind for kind, labels in LABELS.items() for label in labels.split()}
# Labels of fields that give a name its role, the first role first.
ROLES = {
    "patient_name": r"patient(?:\s+full)?\s+name|patient|name\s+of\s+patient|اسم\s+المريض|اسم\s+المريضة|المريض|المريضة",
    "physician_name": r"physician|reporting\s+physician|doctor|consultant|admitting\s+consultant|consultant\s+pathologist|reporting\s+radiologist|radiologist|referring\s+physician|attending\s+physician"
    r"|authorized\s+by|approved\s+by|reported\s+by|verified\s+by|signed\s+by|clinician|طبيب|الطبيب|طبيب\s+الأشعة|استشاري|الاستشاري|اعتمد\s+بواسطة|معتمد\s+بواسطة|أخصائي|الأخصائي",
    "nurse_name": r"nurse|assigned\s+nurse|triage\s+nurse|school\s+nurse|vaccinator|registered\s+nurse|rn|ممرضة|الممرضة|ممرض|الممرض|ممرضة\s+المدرسة|ممرض\s+المدرسة",
    "guardian_name": r"guardian|guardian\s+name|parent|parent\s+name|ولي\s+الأمر|اسم\s+ولي\s+الأمر|الوصي|اسم\s+الوصي",
    "relative_name": r"next\s+of\s+kin|relative|spouse|family\s+contact|emergency\s+contact|قريب|اسم\s+القريب|ذوي\s+المريض|أقرب\s+الأقارب|جهة\s+الاتصال|الزوج|الزوجة",
    "employee_name": r"employee|employee\s+name|staff\s+name|اسم\s+الموظف|الموظف|اسم\s+العامل",
    "student_name": r"student|student\s+name|pupil|child\s+name|اسم\s+الطالب|اسم\s+الطالبة|الطالب|الطالبة|اسم\s+الطفل|اسم\s+الطفلة",
}
# Words for roles, and words for documents, that identify nobody.
SAFE_ROLES = (
    "radiologist|reporting radiologist|physician|reporting physician|attending physician|referring physician|consultant|consultant pathologist|pathologist|clinician|doctor|surgeon|anesthetist|anaesthetist|nurse"
    "|registered nurse|school nurse|vaccinator|public health officer|laboratory technician|radiology technician|medical officer|occupational physician|obstetrician|intensivist|طبيب|الطبيب|طبيب الأشعة|طبيب اشعة"
    "|استشاري|الاستشاري|استشاري الأشعة|استشاري الباثولوجي|أخصائي|الأخصائي|جراح|طبيب التخدير|ممرض|الممرض|ممرضة|الممرضة|مسؤول الصحة العامة"
).split("|")
SAFE_DOCUMENTS = (
    "document|medical document|medical record|medical report|clinical report|laboratory report|radiology report|pathology report|discharge summary|operative note|referral letter|confidential"
    "|confidential medical document|hospital information system|health information system|electronic medical record|electronic health record|report|record|medical|clinical|مستند|مستند طبي|تقرير|تقرير طبي"
    "|سجل طبي|نظام معلومات المستشفى|نظام المعلومات الصحية|سري"
).split("|")
# What stands near a professional's role, and before a patient's name.
PROFESSIONAL = (
    r"(?i)\b(?:reporting\s+radiologist|reporting\s+physician|admitting\s+consultant|consultant\s+pathologist|attending\s+physician|referring\s+physician|authorized\s+by|approved\s+by|verified\s+by|reported\s+by|signed\s+by)\b"
    r"|طبيب\s+الأشعة|استشاري\s+الأشعة|استشاري\s+الباثولوجي|اعتمد\s+بواسطة|تم\s+الاعتماد\s+بواسطة"
)
PATIENT = r"patient|اسم\s+المريض"
# Placeholders as other engines leave them; the form of identifiers with a prefix.
PLACEHOLDER = r"(?i)^\[(?:first_name|last_name|middle_name|user_name|username|occupation|bic|organization|location|person|name)\]$"
PREFIXED = r"(?i)(?:MRN|VIS|ACC|SP|LAB|DOC|EMP|STU)[-_]?[A-Z0-9\-]{3,}"
DIGIT = "[0-9٠-٩۰-۹]"
WHOLE_PHONE = rf"^(?:\+\s*)?{DIGIT}(?:[\s().\-/]*{DIGIT}){{6,14}}$"
WHOLE_EMAIL = r"(?i)^[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}$"
SUSPECT_LABELS = ("bic", "swift", "iban", "occupation")
# Types by how they are decided.
IDENTIFIERS = ["civil_id", "mrn", "visit_number", "accession_number", "specimen_number", "lab_number", "document_id", "insurance_number", "employee_number", "student_number"]
STRUCTURED = [k for k in IDENTIFIERS if k not in ("civil_id", "insurance_number")]
NAMED = ["patient_name", "guardian_name", "relative_name", "employee_name", "student_name", "physician_name", "nurse_name"]
DATES = ["admission_date", "discharge_date", "collection_date", "exam_date", "general_date"]
# Priorities of sources, decisions and types in settling overlaps.
SOURCE_PRIORITY = {"field_rule": 100, "arabic_rule": 95, "inline_rule": 90, "ner": 60, "external": 50, "unknown": 10}
DECISION_PRIORITY = {"accept": 100, "keep": 90, "review_required": 70, "pending": 50, "reject": 10}
TYPE_PRIORITY = {
    **dict.fromkeys([*IDENTIFIERS, "phone_number", "email", "patient_name"], 100),
    **dict.fromkeys(["guardian_name", "relative_name", "employee_name", "student_name", "physician_name", "nurse_name", "address", "date_of_birth"], 95),
    "person_name": 70, **dict.fromkeys(["professional_role", "organization", "location", "general_date"], 40), "unknown": 10,
}
#: Every type that a candidate may have.
KINDS = sorted({*KIND_OF.values(), *TYPE_PRIORITY})
SOURCES, DECISIONS = tuple(SOURCE_PRIORITY), tuple(DECISION_PRIORITY)


def struct(**fields: Column) -> Column:
    """A candidate; fields that aren't given are null, a new one is pending."""
    given = {"decision": F.lit("pending"), **fields}
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def changed(x: Column, **fields: Column) -> Column:
    """A copy of a candidate with other values of some fields."""
    return F.struct(*[(fields[k].cast(t) if k in fields else x[k]).alias(k) for k, t in FIELDS.items()])


def none() -> Column:
    return F.array().cast(f"array<{CANDIDATE}>")


# -- where candidates come from


def of_rules(text: Column, rules: list[tuple[str, str, str, str, int, int]], first: int = 0) -> Column:
    """Candidates of rules (name, type, source, pattern, lead, value), in the order of the rules, which settles ties; blank values are left out."""

    def one(i: int, rule: tuple[str, str, str, str, int, int]) -> Column:
        return F.transform(located(text, *rule[3:]), lambda x: F.struct(F.lit(i).alias("i"), x.alias("x")))

    if not rules:
        return none()
    facts = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("kind"), F.lit(r[2]).alias("source")) for r in rules])

    def whole(y: Column) -> Column:
        x, r = y["x"], F.get(facts, y["i"])
        return struct(seq=y["i"] + first, rule=r["rule"], source=r["source"], label=r["kind"], kind=r["kind"], start_pos=x["start_pos"], end_pos=x["end_pos"], value=x["value"], confidence=F.lit(1.0))

    found = F.concat(*[one(i, r) for i, r in enumerate(rules)])
    return F.transform(F.filter(found, lambda y: F.trim(y["x"]["value"]) != ""), whole)


def distinct_spans(found: Column) -> Column:
    """One candidate for each start, end and type: of the strongest source, then of the first rule; by position."""
    rank = lambda x: F.struct(x["start_pos"], x["end_pos"], x["kind"], -lookup(SOURCE_PRIORITY, x["source"], 0), x["seq"])
    ordered = F.transform(F.array_sort(F.transform(found, lambda x: F.struct(rank(x).alias("r"), x.alias("x")))), lambda y: y["x"])
    same = lambda a, b: (a["start_pos"] == b["start_pos"]) & (a["end_pos"] == b["end_pos"]) & (a["kind"] == b["kind"])
    return bound(ordered, lambda o: F.filter(o, lambda x, i: (i == 0) | ~same(F.get(o, F.greatest(i - 1, F.lit(0))), x)))


def whole_number(value: Column) -> Column:
    """An integer from a number or a string of digits; null for fractions, truth values and anything else."""
    s = F.trim(value.cast("string"))
    return F.when(s.rlike(r"^-?[0-9]+(?:\.0*)?$"), F.regexp_replace(s, r"\.0*$", "").try_cast("bigint"))


def share(value: Column) -> Column:
    """A number from 0 to 1; null for anything else."""
    n = F.trim(value.cast("string")).try_cast("double")
    return F.when(n.between(0, 1), n)


# The names under which recognisers give a field.
ALIASES = {
    "start": ("start", "start_index", "begin", "offset_start"), "end": ("end", "end_index", "stop", "offset_end"), "label": ("raw_label", "label", "entity_type", "type"),
    "other": ("canonical_label", "normalized_label"), "confidence": ("confidence", "score", "probability"),
}
METADATA = ("model_id", "threshold", "action", "language", "reversible_id", "hash_value", "evidence", "sources", "metadata")


def _first(x: Column, has: list[str], names: Iterable[str], parts: dict[str, bool], blank: bool = False) -> Column:
    """The first of a struct's fields by these names that isn't null; truth values count as null."""
    found = [x[n].cast("string") for n in names if n in has and parts[n]]
    out = F.coalesce(*found) if found else F.lit(None).cast("string")
    return F.nullif(F.trim(out), F.lit("")) if blank else out


def of_recogniser(text: Column, entities: Column, schema: ArrayType, first: int = 1000) -> Column:
    """Candidates from the entities that another recogniser found, an array of structs with fields under any of the usual names.

    Offsets decide: the value is what stands there. Offsets may stand in ``evidence`` instead; spans that are missing, empty or
    outside the text are dropped, and a confidence that is no share is null.
    """
    struct_type: StructType = schema.elementType
    has = struct_type.fieldNames()
    parts = {f.name: f.dataType.simpleString() != "boolean" for f in struct_type.fields}
    inner = struct_type["evidence"].dataType.fieldNames() if "evidence" in has and isinstance(struct_type["evidence"].dataType, StructType) else []

    def bound(x: Column, name: str, fallback: str) -> Column:
        own = whole_number(_first(x, has, ALIASES[name], parts))
        return F.coalesce(own, whole_number(x["evidence"][fallback])) if fallback in inner else own

    def one(x: Column, i: Column) -> Column:
        start, end = bound(x, "start", "normalized_start"), bound(x, "end", "normalized_end")
        label, other = (_first(x, has, ALIASES[n], parts, blank=True) for n in ("label", "other"))
        value = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
        return struct(seq=i + first, rule=F.lit("recogniser"), source=F.lit("external"), label=F.coalesce(label, other), other_label=other, kind=F.lit("unknown"), start_pos=start, end_pos=end, value=value, confidence=share(_first(x, has, ALIASES["confidence"], parts)))

    made = F.transform(F.coalesce(entities, F.array().cast(schema)), one)
    return F.filter(made, lambda x: (x["start_pos"] >= 0) & (x["end_pos"] > x["start_pos"]) & (x["end_pos"] <= F.length(text)))


def recogniser_metadata(x: Column, has: Iterable[str]) -> Column:
    """map<string, string> of what a recogniser tells besides the span, as JSON where it is nested; nulls are left out."""
    kept = [n for n in METADATA if n in set(has)]
    pairs = [F.struct(F.lit(n).alias("key"), F.when(x[n].isNotNull(), F.to_json(F.struct(x[n].alias("v")))).alias("value")) for n in kept]
    entries = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()) if pairs else F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.transform(entries, lambda p: F.struct(p["key"], F.regexp_replace(F.regexp_replace(p["value"], r'^\{"v":', ""), r"\}$", "").alias("value"))))


# -- checks of the contract


def sound(x: Column) -> Column:
    """Whether a candidate is one: a value, a span, a known source, type and decision, and a confidence that is a share if there is one."""
    known = x["source"].isin(*SOURCES) & x["kind"].isin(*KINDS) & x["decision"].isin(*DECISIONS)
    return (F.length(F.trim(x["value"])) > 0) & (x["start_pos"] >= 0) & (x["end_pos"] > x["start_pos"]) & (x["confidence"].isNull() | x["confidence"].between(0, 1)) & known


def stands(text: Column, x: Column) -> Column:
    """Whether a candidate's value is what its offsets hold."""
    return (x["end_pos"] <= F.length(text)) & (F.substring(text, x["start_pos"] + 1, x["end_pos"] - x["start_pos"]) == x["value"])


def width(x: Column) -> Column:
    return x["end_pos"] - x["start_pos"]


# -- types and roles


def label_form(label: Column) -> Column:
    """Small letters without brackets around, anything but a-z, digits and Arabic as one underscore."""
    bare = F.regexp_replace(F.lower(F.trim(label)), r"^[\[\]<>():{}\s]+|[\[\]<>():{}\s]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9؀-ۿ]+", "_"), "^_+|_+$", "")


def kind_of(label: Column) -> Column:
    """The type that a label means; unknown if it is none of them."""
    return lookup(KIND_OF, label_form(label), "unknown")


def typed(found: Column, again: bool = False) -> Column:
    """Candidates of unknown type get the one of their label; with ``again`` all do."""
    use = lambda x: F.coalesce(x["label"], x["other_label"], F.lit(""))
    return F.transform(found, lambda x: F.when((x["kind"] == "unknown") | F.lit(again), changed(x, kind=kind_of(use(x)))).otherwise(x))


def role_of(label: Column) -> Column:
    """The role that a field's label gives to a name in it; null for other labels."""
    form = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.trim(label), ":+$", "")), r"\s+", " "))


    def first(f: Column) -> Column:
        out = F
        for role, p in ROLES.items():
            out = out.when(f.rlike(f"(?iu)^(?:{p})$"), role)
        return out

    return bound(form, first)


FIELD_LINE = r"([^\r\n:]{1,80}\s*:\s*)([^\r\n]+)"


def with_roles(text: Column, found: Column, near: int = 120, lines: int = 3) -> Column:
    """Names of unknown role get that of the field they stand in, else that of the nearest of the last ``lines`` lines before them."""

    def role(x: Column, fields: Column) -> Column:
        over = F.get(F.filter(fields, lambda f: (x["start_pos"] < f["end_pos"]) & (x["end_pos"] > f["start_pos"])), F.lit(0))
        own = role_of(F.get(F.split(over["lead"], ":"), F.lit(0)))
        at = F.greatest(x["start_pos"] - near, F.lit(0))
        before = F.filter(F.transform(text_lines(F.substring(text, at + 1, x["start_pos"] - at)), lambda y: F.trim(y)), lambda y: y != "")
        told = F.filter(F.transform(bound(before, lambda b: F.slice(F.reverse(b), 1, lines)), role_of), lambda y: y.isNotNull())
        return F.coalesce(own, F.get(told, F.lit(0)))

    unsure = lambda x: x["kind"].isin("person_name", "unknown")
    given = lambda f, fields: F.transform(f, lambda x: F.when(unsure(x), changed(x, kind=F.coalesce(role(x, fields), x["kind"]))).otherwise(x))
    return bound(found, lambda f: F.when(F.exists(f, unsure), bound(located(text, FIELD_LINE, 1, 2), lambda fields: given(f, fields))).otherwise(f))


# -- decisions


def context_form(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[\[\]<>():{}]", " "), r"\s+", " "))


def window(text: Column, x: Column, radius: int) -> Column:
    """What stands up to ``radius`` signs around a candidate."""
    start = F.greatest(x["start_pos"] - radius, F.lit(0))
    return F.substring(text, start + 1, x["end_pos"] + radius - start)


def identifier_decision(kind: Column, value: Column) -> Column:
    """Accept what has the form of its type, else ask for a review; insurance numbers, addresses and dates of birth have no form."""
    v = F.trim(value)
    ok = (
        F.when(kind == "phone_number", v.rlike(WHOLE_PHONE)).when(kind == "email", v.rlike(WHOLE_EMAIL)).when(kind == "civil_id", digits_folded(v).rlike("^[0-9]{12}$"))
        .when(kind.isin(*STRUCTURED), (F.length(v) >= 4) & (v.rlike(PREFIXED) | v.rlike(r"\p{Nd}"))).otherwise(True)
    )
    return F.when(ok, "accept").otherwise("review_required")


def decision(text: Column, x: Column) -> Column:
    """struct<decision, reason> of a candidate by its type, value and what stands around it.

    A candidate that is decided stays so; offsets that don't hold the value need a review.
    """
    kind, form = x["kind"], context_form(x["value"])
    near = context_form(window(text, x, 80))
    suspect = (context_form(F.coalesce(x["label"], F.lit(""))).isin(*SUSPECT_LABELS) | context_form(F.coalesce(x["other_label"], F.lit(""))).isin(*SUSPECT_LABELS)) & near.rlike("|".join(SAFE_DOCUMENTS))
    before = F.greatest(x["start_pos"] - 100, F.lit(0))
    patient = context_form(F.substring(text, before + 1, x["start_pos"] - before)).rlike(PATIENT)
    said = lambda d, why: F.struct(F.lit(d).alias("decision"), F.lit(why).alias("reason"))
    either = lambda c, yes, no, why: F.struct(F.when(c, yes).otherwise(no).alias("decision"), F.lit(why).alias("reason"))
    return (
        F.when(x["decision"] != "pending", F.struct(x["decision"].alias("decision"), x["reason"].alias("reason")))
        .when(~stands(text, x), said("review_required", "offsets don't hold the value"))
        .when(F.trim(x["value"]).rlike(PLACEHOLDER), said("reject", "placeholder of another engine"))
        .when(kind.isin(*IDENTIFIERS, "phone_number", "email", "address", "date_of_birth"), F.struct(identifier_decision(kind, x["value"]).alias("decision"), F.lit("form of the identifier").alias("reason")))
        .when(kind.isin(*NAMED), said("accept", "name with a role"))
        .when(kind == "professional_role", either(form.isin(*SAFE_ROLES) | window(text, x, 60).rlike(PROFESSIONAL), "reject", "review_required", "professional role"))
        .when(kind == "unknown", either(form.isin(*SAFE_DOCUMENTS) | suspect, "reject", "review_required", "unknown type"))
        .when(kind == "person_name", either(patient, "accept", "review_required", "name without a role"))
        .when(kind.isin("organization", "location"), said("review_required", "organisation or place"))
        .when(kind.isin(*DATES), said("accept", "date"))
        .otherwise(said("review_required", "no rule for the type"))
    )


def decided(text: Column, found: Column) -> Column:
    both = F.transform(found, lambda x: F.struct(x.alias("x"), decision(text, x).alias("d")))
    return F.transform(both, lambda y: changed(y["x"], decision=y["d"]["decision"], reason=y["d"]["reason"]))


# -- overlaps


def score(x: Column) -> Column:
    tenths = F.when(x["confidence"].isNull(), 0).otherwise(F.floor(x["confidence"] * 10).cast("int"))
    return lookup(SOURCE_PRIORITY, x["source"], 0) + lookup(DECISION_PRIORITY, x["decision"], 0) + lookup(TYPE_PRIORITY, x["kind"], 0) + tenths


def overlap(x: Column, y: Column) -> Column:
    return (x["start_pos"] < y["end_pos"]) & (x["end_pos"] > y["start_pos"])


def settled(found: Column) -> Column:
    """The candidates without overlaps, by position: the highest score first, then the longest, then the first.

    Where the strongest that a candidate overlaps has its score and length, the surer of the two stays, and takes the place
    of all that it overlaps.
    """
    ranked = F.transform(found, lambda x: F.struct((-score(x)).cast("int").alias("s"), (-width(x)).cast("int").alias("w"), x["start_pos"].alias("a"), x["seq"].alias("q"), x.alias("x")))
    ordered = F.array_sort(ranked)
    empty = F.array().cast(f"array<struct<s:int,w:int,a:int,q:int,x:{CANDIDATE}>>")

    def step(kept: Column, y: Column) -> Column:
        return bound(F.filter(kept, lambda k: overlap(k["x"], y["x"])), lambda over: chosen(kept, y, over, F.get(over, F.lit(0))))

    def chosen(kept: Column, y: Column, over: Column, top: Column) -> Column:
        surer = y["x"]["confidence"].isNotNull() & (top["x"]["confidence"].isNull() | (y["x"]["confidence"] > top["x"]["confidence"]))
        wins = (top["s"] == y["s"]) & (top["w"] == y["w"]) & surer
        return F.when(F.size(over) == 0, F.concat(kept, F.array(y))).when(wins, F.concat(F.filter(kept, lambda k: ~overlap(k["x"], y["x"])), F.array(y))).otherwise(kept)

    kept = F.aggregate(ordered, empty, step)
    place = F.transform(kept, lambda y: F.struct(y["x"]["start_pos"].alias("a"), y["x"]["end_pos"].alias("b"), y["x"].alias("x")))
    return F.transform(F.array_sort(place), lambda y: y["x"])


def pipeline(text: Column, *groups: Column) -> Column:
    """Groups of candidates in their order to typed, decided candidates without overlaps."""
    return settled(decided(text, with_roles(text, typed(F.concat(*groups)))))


def unsound_output(text: Column, found: Column) -> Column:
    """Accepted candidates whose offsets don't hold their value or that overlap the one before: must be empty before a text is rewritten."""
    before = lambda a, i: F.get(a, F.greatest(i - 1, F.lit(0)))["end_pos"]
    return bound(F.filter(found, lambda x: x["decision"] == "accept"), lambda a: F.filter(a, lambda x, i: ~stands(text, x) | ((i > 0) & (x["start_pos"] < before(a, i)))))


def warnings(found: Column) -> Column:
    """A line for each candidate that needs a review, then for each that is pending."""
    part = lambda d, word: F.transform(F.filter(found, lambda x: x["decision"] == d), lambda x: F.format_string(word + " '%s' (%s) at %d:%d", x["value"], x["kind"], x["start_pos"], x["end_pos"]))
    return F.concat(part("review_required", "to review:"), part("pending", "pending:"))


def counted(found: Column) -> Column:
    """struct with the number of candidates by decision."""
    those = lambda d: F.filter(found, lambda x: x["decision"] == d)
    return F.struct(*[F.size(those(d)).alias(d) for d in DECISIONS])


def exploded(df: DataFrame, keys: list[str], found: Column) -> DataFrame:
    """One row for each candidate."""
    return df.select(*keys, F.inline(found))
