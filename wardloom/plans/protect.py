"""De-identification by rules: detect, settle overlaps, decide by policy, rewrite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.scalars import bound, lookup, transformed, with_worked_out
from wardloom.operators import candidates
from wardloom.operators.candidates import DATES, DIGIT, IDENTIFIERS
from wardloom.operators.spans import rewritten
from wardloom.operators.terms import restored

# Blanks, the separator of a label and its value, and the classes of values.
BLANK = "[\\s  -     　]"
SEPARATOR = f"{BLANK}*(?:[:#=]|[-–—])?{BLANK}*"
PHONE = f"(?:\\+{BLANK}*)?{DIGIT}(?:(?:{BLANK}|[().\\-/])*{DIGIT}){{6,14}}"
EMAIL = "[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}"
IDENTIFIER = "[A-Za-z0-9][A-Za-z0-9._/\\-]{2,}"
LINE_VALUE = "[^\\r\\n:]{2,120}?"
# Labels of fields in English and Arabic, the type of their value, and its class.
NUMBER_OR_NO = f"{BLANK}*(?:number|no\\.?)"
NUMBER_NO_ID = f"{BLANK}*(?:number|no\\.?|id)"
FIELDS = [
    ("patient_name_field", "patient_name", f"patient{BLANK}+name|deceased{BLANK}+name|اسم{BLANK}+المريض|اسم{BLANK}+المتوف(?:ى|اة)", LINE_VALUE),
    ("phone_field", "phone_number", f"(?:phone|telephone|mobile|cell|tel)(?:{NUMBER_OR_NO})?|contact{NUMBER_OR_NO}|(?:رقم{BLANK}*)?(?:الهاتف|هاتف|الجوال|جوال|الموبايل|موبايل)", PHONE),
    ("email_field", "email", f"e[\\s\\-]?mail(?:{BLANK}*address)?|البريد{BLANK}+(?:الإلكتروني|الالكتروني)", EMAIL),
    ("civil_id_field", "civil_id", f"civil{BLANK}*(?:id|i\\.d\\.)|civil{BLANK}+number|cid|الرقم{BLANK}+المدني|رقم{BLANK}+مدني", f"{DIGIT}{{12}}"),
    ("mrn_field", "mrn", f"mrn|(?:medical|patient){BLANK}+record{BLANK}+(?:number|no\\.?)|رقم{BLANK}+الملف{BLANK}+الطبي|رقم{BLANK}+الملف", IDENTIFIER),
    ("visit_number_field", "visit_number", f"(?:visit|encounter){NUMBER_NO_ID}|رقم{BLANK}+الزيارة", IDENTIFIER),
    ("accession_number_field", "accession_number", f"accession(?:{NUMBER_NO_ID})?|رقم{BLANK}+الأكسشن|رقم{BLANK}+الاكسشن", IDENTIFIER),
    ("specimen_number_field", "specimen_number", f"(?:specimen|sample){NUMBER_NO_ID}|رقم{BLANK}+العينة", IDENTIFIER),
    ("lab_number_field", "lab_number", f"lab(?:oratory)?{NUMBER_NO_ID}|رقم{BLANK}+(?:المختبر|المعمل)", IDENTIFIER),
    ("document_id_field", "document_id", f"(?:document|report|form|(?:electronic{BLANK}+)?signature){NUMBER_NO_ID}|(?:رقم|معرف){BLANK}+التوقيع{BLANK}+الإلكتروني|رقم{BLANK}+(?:المستند|التقرير)", IDENTIFIER),
    ("record_checksum_field", "document_id", f"record{BLANK}+(?:checksum|hash)|(?:document|report){BLANK}+checksum|بصمة{BLANK}+(?:السجل|المستند|التقرير)", IDENTIFIER),
    ("insurance_number_field", "insurance_number", f"insurance{NUMBER_NO_ID}|policy{NUMBER_OR_NO}|رقم{BLANK}+التأمين", IDENTIFIER),
    ("employee_number_field", "employee_number", f"(?:employee|staff){NUMBER_NO_ID}|(?:medical|professional){BLANK}+license{NUMBER_NO_ID}|رقم{BLANK}+الموظف", IDENTIFIER),
    ("student_number_field", "student_number", f"(?:student|school){NUMBER_NO_ID}|رقم{BLANK}+الطالب", IDENTIFIER),
]


def field_pattern(label: str, value: str) -> str:
    """Group 1 is all before the value, group 2 the value."""
    tail = f"{BLANK}*(?:\\r?\\n|$)" if value == LINE_VALUE else ""
    return f"(?i)((?:{label}){SEPARATOR})({value}){tail}"


FIELD_RULES = [(name, kind, "field_rule", field_pattern(label, value), 1, 2) for name, kind, label, value in FIELDS]
EMAIL_RULE = ("inline_email", "email", "inline_rule", "(?i)(?<![A-Z0-9._%+\\-])[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{2,}(?![A-Z0-9._%+\\-])", 0, 0)
PHONE_RULE = ("inline_phone", "phone_number", "inline_rule", f"(?<!{DIGIT})\\+{BLANK}*965(?:(?:{BLANK}|[().\\-])*{DIGIT}){{8}}(?!{DIGIT})", 0, 0)
# Inline identifiers, prefix included.
PREFIXES = [("mrn", "MRN"), ("lab_number", "LAB"), ("visit_number", "VIS"), ("accession_number", "ACC"), ("specimen_number", "SP")]
AFTER, AFTER_LAB = "(?:[-:][ \\t]*|[ \\t]+)", "[-:][ \\t]*"
INLINE_RULES = [(f"inline_{k}", k, "inline_rule", f"(?i)\\b{p}{AFTER_LAB if p == 'LAB' else AFTER}[A-Za-z0-9][A-Za-z0-9-]*\\b", 0, 0) for k, p in PREFIXES]
# Labels that stand at the start of a line before a colon, and the type of what follows, on the line or the next that isn't empty.
LINE_LABELS = [
    ("patient_name", "patient|patient[ \\t]+name"), ("civil_id", "civil[ \\t]+id"), ("mrn", "mrn|medical[ \\t]+record[ \\t]+number"), ("visit_number", "visit[ \\t]+number"),
    ("lab_number", "lab(?:oratory)?[ \\t]+number"), ("accession_number", "accession[ \\t]+number"), ("specimen_number", "specimen[ \\t]+number"),
]
# Labels of clinicians with the title inside the span, and with the title before it.
CLINICIAN_LABELS = "consultant|physician|doctor|consultant[ \\t]+pathologist|(?:attending|requesting|authorized)[ \\t]+physician|(?:authorized|reported)[ \\t]+by"
PHYSICIAN_LABELS = "reporting[ \\t]+physician|admitting[ \\t]+consultant|consultant[ \\t]+pathologist|طبيب[ \\t]+الأشعة|الطبيب[ \\t]+المعالج|استشاري[ \\t]+(?:الباثولوجي|علم[ \\t]+الأمراض)"
REST_OF_LINE = "[^\\r\\n=]*[^\\r\\n=\\s]"


def line_pattern(labels: str, title: str = "", inside: str = "") -> str:
    """Group 1 is the label, its colon and any title before the value, group 2 the value, which ends its line, whatever kind of line end it has."""
    return f"(?imd)(^[ \\t]*(?:{labels})[ \\t]*:[ \\t]*(?:\\r?\\n[ \\t]*)*{title})({inside}{REST_OF_LINE})[ \\t]*\\r?$"


CONTEXT_RULES = [(f"context_{k}", k, "field_rule", line_pattern(label), 1, 2) for k, label in LINE_LABELS] + [
    ("context_clinician", "physician_name", "field_rule", line_pattern(CLINICIAN_LABELS, inside="Dr\\.[ \\t]+"), 1, 2),
    ("context_physician", "physician_name", "field_rule", line_pattern(PHYSICIAN_LABELS, title="(?:Dr|د)\\.?[ \\t]+"), 1, 2),
]
#: All rules, in the order that settles ties: fields of whole lines, inline prefixes, then fields anywhere, e-mails and phones.
RULES = [*CONTEXT_RULES, *INLINE_RULES, *FIELD_RULES, EMAIL_RULE, PHONE_RULE]
# What each policy does with each type.
NAMES = ["person_name", "patient_name", "guardian_name", "relative_name", "employee_name", "student_name"]
POLICY = [  # types, clinical, research, analytics_public_health, strict_privacy
    (NAMES, "replace", "replace", "replace", "remove"), (["physician_name", "nurse_name"], "keep", "remove", "remove", "remove"), (IDENTIFIERS, "hash", "hash", "hash", "remove"),
    (["phone_number", "email", "address"], "replace", "remove", "remove", "remove"), (["date_of_birth"], "keep", "remove", "remove", "remove"), (DATES, "keep", "remove", "remove", "remove"),
    (["organization", "location"], "keep", "keep", "keep", "remove"), (["professional_role"], "keep", "keep", "keep", "keep"), (["unknown"], "mask", "remove", "remove", "remove"),
]
PROFILES = ("clinical", "research", "analytics_public_health", "strict_privacy")


def policy_rows() -> list[tuple[str, str, str]]:
    return [(p, t, row[1 + i]) for row in POLICY for t in row[0] for i, p in enumerate(PROFILES)]


def actions(profile: str, kind: Column) -> Column:
    """The action of ``profile`` for a type; types that it doesn't name are kept."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    return F.coalesce(F.create_map(*[F.lit(x) for p, t, a in policy_rows() if p == profile for x in (t, a)])[kind], F.lit("keep"))


# Older names of policies, and of types.
PROFILE_ALIASES = {"mednexus_default": "clinical", "mednexus_clinical": "clinical", "research": "research", "strict": "strict_privacy"}
TARGET_ALIASES = {"hospital": "organization", "unknown_pii": "unknown"}


def profile_named(name: Column) -> Column:
    """The policy that a name, old or new, in any case, stands for; null for others."""
    low = F.lower(F.trim(name))
    return F.when(low.isin(*PROFILES), low).otherwise(lookup(PROFILE_ALIASES, low, None))


def target(kind: Column) -> Column:
    """The type that policies know a name of a type by; null if there is none."""
    low = F.lower(F.trim(kind))
    return F.nullif(F.coalesce(lookup(TARGET_ALIASES, low, None), low), F.lit(""))


def unmapped(rows: DataFrame) -> DataFrame:
    """(profile, kind) that a policy table has no, or more than one, action for, or an unknown one, out of all profiles and types it names."""
    every = rows.select("profile").distinct().crossJoin(F.broadcast(rows.select("kind").distinct()))  # both are names of a policy table: a few dozen rows
    n = rows.groupBy("profile", "kind").agg(F.count("*").alias("n"), F.count_if(~F.col("action").isin("keep", "replace", "hash", "mask", "remove")).alias("odd"))
    return every.join(n, ["profile", "kind"], "left").where("n is null or n > 1 or odd > 0").select("profile", "kind")


def found_by_rules(text: Column, rules: list | None = None) -> Column:
    """The candidates of all rules, one for each span and type."""
    return candidates.distinct_spans(candidates.of_rules(text, RULES if rules is None else rules))


def detected(df: DataFrame, keys: list[str], text: str = "text", rules: list | None = None) -> DataFrame:
    """The strongest candidate of each span and type, a row each: fields before inline rules, labels of whole lines first among fields."""
    found = df.where(F.col(text).isNotNull()).select(*keys, found_by_rules(F.col(text), rules).alias("_found"))
    return candidates.exploded(found, keys, F.col("_found"))


def judged(df: DataFrame, text: str = "text", entities: str | None = None, rules: list | None = None, name: str = "found") -> DataFrame:
    """``df`` with ``found``: its typed, decided candidates without overlaps, from the rules and, if a column of ``entities`` is named, from another recogniser."""
    t = F.col(text)
    groups = [candidates.of_rules(t, RULES if rules is None else rules)]
    if entities:
        groups.append(candidates.of_recogniser(t, F.col(entities), df.schema[entities].dataType))
    return with_worked_out(df, **{name: F.when(t.isNotNull(), candidates.pipeline(t, *groups))})


def output(text: Column, found: Column, profile: str, hash_length: int = 10) -> Column:
    """struct of the text under a policy and its counts.

    Accepted candidates are transformed, others stay. ``safe`` is false if any needs a review or is pending. Accepted
    candidates must hold their value and not overlap; those that don't are left as they are and make the text unsafe.
    """
    if hash_length < 6:
        raise ValueError("hashes have 6 signs at least")
    sound = lambda odd: F.filter(found, lambda x: (x["decision"] == "accept") & ~F.exists(odd, lambda y: y["seq"] == x["seq"]))
    acts = lambda odd: F.transform(sound(odd), lambda x: F.struct(x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), x["kind"].alias("kind"), actions(profile, x["kind"]).alias("action"), x["value"].alias("value")))
    acted = lambda a: F.transform(F.filter(a, lambda x: x["action"] != "keep"), lambda x: F.struct(x["start_pos"], x["end_pos"], transformed(x["value"], x["kind"], x["action"], hash_length).alias("replacement")))

    def made(odd: Column, a: Column, done: Column, n: Column) -> Column:
        return F.struct(
            F.size(done).alias("n_replaced"), (n["keep"] + F.size(a) - F.size(done)).alias("n_kept"), n["reject"].alias("n_rejected"), n["review_required"].alias("n_review"), n["pending"].alias("n_pending"),
            ((n["review_required"] + n["pending"] + F.size(odd)) == 0).alias("safe"), candidates.warnings(found).alias("warnings"), rewritten(text, done).alias("protected"),
        )

    counted = candidates.counted(found)
    return bound(candidates.unsound_output(text, found), lambda odd: bound(acts(odd), lambda a: bound(acted(a), lambda done: bound(counted, lambda n: made(odd, a, done, n)))))


COUNTS = ("n_replaced", "n_kept", "n_rejected", "n_review", "n_pending", "safe", "warnings", "protected")


def deidentified(df: DataFrame, keys: list[str], profile: str, text: str = "text", entities: str | None = None, mask: Callable[[Column], Column] | None = None) -> DataFrame:
    """keys, n_replaced, n_kept, n_rejected, n_review, n_pending, safe, warnings, protected: the text of each row under a policy.

    Row by row, without a shuffle; repeated rows come out repeated. ``mask`` takes a text to a struct of ``text``, with terms
    replaced by tokens while candidates are looked for, and ``tokens``; they are given back in the end. A null text has no
    counts and a null result; a text without candidates stays as it is.
    """
    src = df.select(*keys, F.col(text).alias("_t"), *([F.col(entities).alias("_e")] if entities else []))
    if mask:
        src = with_worked_out(src, _m=mask(F.col("_t"))).withColumn("_t", F.col("_m.text")).withColumn("_tokens", F.col("_m.tokens"))
    out = with_worked_out(judged(src, "_t", "_e" if entities else None, name="_found"), _out=F.when(F.col("_t").isNotNull(), output(F.col("_t"), F.col("_found"), profile)))
    cols = [F.col(f"_out.{c}").alias(c) for c in COUNTS[:-1]]
    done = F.col("_out.protected")
    return out.select(*keys, *cols, (restored(done, F.col("_tokens")) if mask else done).alias("protected"))
