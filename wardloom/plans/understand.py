"""What a document is: language by script, sections, profile scores, classification, clinical context and route.

All of it is row by row; sections, signals and scores stay arrays in their document's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.scalars import bound, heading_key, letters, lookup, stable_hash, with_worked_out
from wardloom.operators.spans import located
from wardloom.plans import radiology

# Weighted signals (phrase, weight, category) of the profiles of documents.
PROFILES = {
    ("pathology", "pathology_report"): [
        ("pathology report", 5.0, "title"), ("histopathology", 4.0, "title"), ("gross description", 3.0, "section"), ("microscopic description", 3.0, "section"), ("final diagnosis", 3.0, "section"),
        ("immunohistochemistry", 3.0, "lexical"), ("specimen", 1.5, "section"), ("margins", 1.5, "lexical"), ("تقرير الباثولوجي", 5.0, "title"),
    ],
    ("laboratory", "laboratory_report"): [
        ("laboratory report", 5.0, "title"), ("lab results", 4.0, "title"), ("reference range", 3.0, "structure"), ("test result", 2.0, "structure"), ("units", 1.5, "structure"),
        ("collected", 1.0, "lexical"), ("validated", 1.0, "lexical"), ("تقرير المختبر", 5.0, "title"), ("المدى المرجعي", 3.0, "structure"),
    ],
    ("emergency", "emergency_report"): [
        ("emergency department", 5.0, "title"), ("emergency report", 5.0, "title"), ("chief complaint", 2.0, "section"), ("triage", 2.5, "section"), ("history of present illness", 2.5, "section"),
        ("vital signs", 2.0, "section"), ("ed course", 3.0, "section"), ("disposition", 2.0, "section"), ("قسم الطوارئ", 5.0, "title"),
    ],
    ("admission_discharge", "admission_note"): [
        ("admission note", 5.0, "title"), ("reason for admission", 3.0, "section"), ("admitting diagnosis", 3.0, "section"), ("admission diagnosis", 3.0, "section"), ("assessment and plan", 2.0, "section"),
        ("ملاحظة الدخول", 5.0, "title"),
    ],
    ("admission_discharge", "discharge_summary"): [
        ("discharge summary", 5.0, "title"), ("hospital course", 3.0, "section"), ("discharge diagnosis", 3.0, "section"), ("discharge medications", 3.0, "section"), ("condition on discharge", 2.0, "section"),
        ("follow-up", 1.5, "section"), ("ملخص الخروج", 5.0, "title"),
    ],
    ("public_health", "public_health_document"): [
        ("public health notification", 5.0, "title"), ("communicable disease notification", 5.0, "title"), ("case notification", 4.0, "title"), ("epidemiological investigation", 4.0, "title"),
        ("surveillance report", 4.0, "title"), ("إخطار الصحة العامة", 5.0, "title"), ("ترصد وبائي", 4.0, "title"),
    ],
}
# Sections and the headings that open them; where two share a heading, the first has it.
SECTION_HEADINGS = {
    "clinical_history": "clinical history|history|التاريخ السريري", "recommendation": "recommendation|recommendations|التوصية",
    "clinical_information": "clinical information|المعلومات السريرية|clinical indication|indication|سبب الفحص", "specimen": "specimen|العينة", "gross_description": "gross description",
    "microscopic_description": "microscopic description", "diagnosis": "diagnosis|التشخيص", "final_diagnosis": "final diagnosis", "comment": "comment|comments", "patient_information": "patient information",
    "results": "results|lab results", "reference_range": "reference range", "interpretation": "interpretation", "authorization": "authorization|authorized by", "chief_complaint": "chief complaint|الشكوى الرئيسية",
    "triage": "triage|الفرز", "history_of_present_illness": "history of present illness|hpi", "vital_signs": "vital signs|العلامات الحيوية", "examination": "physical examination|examination",
    "investigations": "investigations", "assessment": "assessment", "treatment": "treatment", "disposition": "disposition", "admission_diagnosis": "admission diagnosis|admitting diagnosis",
    "hospital_course": "hospital course", "procedures": "procedures", "discharge_diagnosis": "discharge diagnosis", "discharge_medications": "discharge medications", "follow_up": "follow-up|follow up",
    "notification_details": "notification details|case notification", "surveillance_summary": "surveillance summary|epidemiological investigation",
    "procedure_information": "procedure information|معلومات الإجراء|procedure details|study information", "radiology_examination": "examination|الفحص", "technique": "technique|الطريقة|التقنية",
    "findings": "findings|النتائج|الموجودات", "impression": "impression|الانطباع|الخلاصة", "comparison": "comparison|المقارنة", "radiologist_authentication": "radiologist|طبيب الأشعة|اختصاصي الأشعة|أخصائي الأشعة",
}
ARABIC, LATIN = "؀-ۿ", "A-Za-z"


def script_language(text: Column, least: float = 0.3, min_letters: int = 4) -> Column:
    """ENGLISH, ARABIC, MIXED or UNKNOWN, from the letters of the whole text, then of its lines."""
    a, e = letters(text, ARABIC), letters(text, LATIN)
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r]"), lambda x: F.struct(letters(x, ARABIC).alias("a"), letters(x, LATIN).alias("e"))), lambda x: x["a"] + x["e"] >= min_letters)
    count = lambda k: F.size(F.filter(lines, lambda x: x[k] / (x["a"] + x["e"]) >= least))
    al, el = count("a"), count("e")
    return (
        F.when(a + e < min_letters, "UNKNOWN").when(a < least * (a + e), "ENGLISH").when(e < least * (a + e), "ARABIC")
        .when((al + el > 0) & (F.least(al, el) >= least * (al + el)), "MIXED").when(al > el, "ARABIC").otherwise("ENGLISH")
    )


def line_sections(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, canonical_name, original_heading, start_pos, end_pos): lines that are a listed heading, alone or before a colon; each section ends where the next begins.

    ``names`` has ``canonical_name`` and ``alias``; it is a list of fixed size and joins by the heading's normal form.
    """
    src = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.length(text).alias("n"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    at = Window.partitionBy("k").orderBy("no")
    src = src.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    head = F.regexp_extract("line", "^[ \t]*([^:\r]{2,60}?)[ \t]*(?::.*)?\r?$", 1)
    lead = F.length(F.regexp_extract("line", "^[ \t]*", 0))
    src = src.select("k", "n", head.alias("heading"), (F.col("at") + lead).cast("int").alias("start_pos")).where("heading != ''").withColumn("name", heading_key(F.col("heading")))
    listed = names.where("alias is not null").select(heading_key(F.col("alias")).alias("name"), "canonical_name").groupBy("name").agg(F.min("canonical_name").alias("canonical_name"))
    found = src.join(listed, "name")
    following = Window.partitionBy("k").orderBy("start_pos")
    return found.select(F.col("k").alias(key), "canonical_name", F.col("heading").alias("original_heading"), "start_pos", F.coalesce(F.lead("start_pos").over(following), F.col("n")).alias("end_pos"))


WORDS, JOINT = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_\r\n:]"
HEADING_KEYS = {}
for _section, _headings in SECTION_HEADINGS.items():
    for _h in _headings.split("|"):
        HEADING_KEYS.setdefault(" ".join(_h.replace("-", " ").split()), _section)
_ALTERNATIVES = "|".join(rf"{JOINT}+".join(k.split()) for k in sorted(HEADING_KEYS, key=lambda k: (-len(k), k)))
_AS_WRITTEN = "|".join(radiology.quoted(h) for h in sorted({h for hs in SECTION_HEADINGS.values() for h in hs.split("|")}, key=lambda h: (-len(h), h)))
#: A line that is a heading, alone or before a colon; headings before a colon anywhere; headings anywhere.
HEADING_LINE = rf"(?imdu)(^[ \t]*)((?:[^\p{{L}}\p{{N}}_\s:]{JOINT}*)?(?:{_ALTERNATIVES})(?:{JOINT}*[^\p{{L}}\p{{N}}_\s:])?)[ \t]*(?::[^\r\n]*)?[ \t]*\r?$"
HEADING_COLON = rf"(?iu)(?<!{WORDS})({_AS_WRITTEN})[ \t]*:"
HEADING_WORD = rf"(?iu)(?<!{WORDS})({_AS_WRITTEN})(?!{WORDS})"
SECTION = "struct<canonical_name:string,original_heading:string,start_pos:int,end_pos:int>"


def _headings(text: Column, pattern: str, lead: int = 0, value: int = 1) -> Column:
    made = F.transform(located(text, pattern, lead, value), lambda x: F.struct(x["start_pos"].alias("s"), (-F.length(x["value"])).cast("int").alias("w"), x["value"].alias("h"), lookup(HEADING_KEYS, heading_key(x["value"]), None).alias("c")))
    return F.filter(made, lambda x: x["c"].isNotNull())


def _apart(headings: Column) -> Column:
    """Headings by place, without those that begin inside the last one kept."""
    last = lambda a: F.try_element_at(a, F.lit(-1))
    ordered = F.array_sort(F.array_distinct(headings))
    return F.aggregate(ordered, F.array().cast("array<struct<s:int,w:int,h:string,c:string>>"), lambda a, x: F.when(F.coalesce(x["s"] < last(a)["s"] - last(a)["w"], F.lit(False)), a).otherwise(F.concat(a, F.array(x))))


def sections_of(text: Column, least: int = 3, front: int = 120) -> Column:
    """array of ``SECTION``: each section from its heading to the next; the last to the end of the text.

    A heading is a line of its own or before a colon, or stands anywhere before a colon. Capitalised headings without colons
    count only as a cluster of at least ``least`` different ones that begins in the first ``front`` signs or fifth of the text.
    """
    upper = r"^[^\p{Lu}\p{Ll}\p{Lt}]*[\p{Lu}\p{Lt}]"
    capital = _apart(F.filter(_headings(text, HEADING_WORD), lambda x: x["h"].rlike(upper)))
    dense = lambda c: (F.size(F.array_distinct(F.transform(c, lambda x: x["c"]))) >= least) & (F.get(c, F.lit(0))["s"] <= F.greatest(F.lit(front), F.floor(F.length(text) / 5)))
    cluster = bound(capital, lambda c: F.when(dense(c), c).otherwise(F.slice(c, 1, 0)))
    ends = lambda f: F.concat(F.slice(F.transform(f, lambda x: x["s"]), 2, F.greatest(F.size(f) - 1, F.lit(0))), F.array(F.length(text)))
    section = lambda x: F.struct(x["f"]["c"].alias("canonical_name"), x["f"]["h"].alias("original_heading"), x["f"]["s"].alias("start_pos"), x["e"].alias("end_pos"))
    whole = lambda f: F.transform(F.arrays_zip(f.alias("f"), F.slice(ends(f), 1, F.size(f)).alias("e")), section)
    return bound(_apart(F.concat(_headings(text, HEADING_LINE, 1, 2), _headings(text, HEADING_COLON), cluster)), whole)


def _has_phrase(text: Column, phrase: str) -> Column:
    return radiology.may_hold(text, [phrase]) & text.rlike(radiology.word_pattern([phrase]))


def scores_of(text: Column, sections: Column, signals: Column) -> Column:
    """array<struct<place, domain, document_type, score, diversity>>: every profile's score, radiology first.

    A phrase counts if it stands alone in the text; a section's, if the text has that section, and once for each section. A
    radiology report without its gate stays below what is accepted; a strong emergency report, admission or discharge damps it.
    """
    present = F.transform(sections, lambda x: x["canonical_name"])
    parts = []
    for i, ((domain, kind), rows) in enumerate(PROFILES.items(), 1):
        hits, seen = [], set()
        for phrase, weight, category in rows:
            if category != "section":
                hits.append((_has_phrase(text, phrase), weight, category))
                continue
            key = " ".join(phrase.replace("-", " ").split())
            named = [s for s, hs in SECTION_HEADINGS.items() if key in {" ".join(h.replace("-", " ").split()) for h in hs.split("|")}]
            if named and HEADING_KEYS[key] not in seen:
                seen.add(HEADING_KEYS[key])
                hits.append((F.arrays_overlap(present, F.array(*map(F.lit, named))), weight, category))
        score = sum((F.when(h, F.lit(w)).otherwise(F.lit(0.0)) for h, w, _ in hits), F.lit(0.0))
        groups: dict[str, Column] = {}
        for h, _, c in hits:
            groups[c] = groups[c] | h if c in groups else h
        diversity = sum((g.cast("int") for g in groups.values()), F.lit(0))
        parts.append(F.struct(F.lit(i).alias("place"), F.lit(domain).alias("domain"), F.lit(kind).alias("document_type"), score.alias("score"), diversity.alias("diversity")))
    raw = radiology.score(signals)
    gated = F.when(radiology.report_satisfied(signals), raw).otherwise(F.least(raw, F.lit(4.9)))
    own = F.struct(F.lit(0).alias("place"), F.lit("radiology").alias("domain"), F.lit("radiology_report").alias("document_type"), gated.alias("score"), radiology.families_present(signals, radiology.FAMILIES).alias("diversity"))
    return damped(F.array(own, *parts))


def damped(scores: Column, strong: float = 8.0) -> Column:
    """Radiology held below the strongest emergency report, admission note or discharge summary, if that is strong."""
    rivals = lambda s: F.array_max(F.transform(F.filter(s, lambda x: x["document_type"].isin("emergency_report", "discharge_summary", "admission_note")), lambda x: x["score"]))
    held = lambda x, rival: F.struct(x["place"], x["domain"], x["document_type"], F.when((x["domain"] == "radiology") & (rival >= strong), F.least(x["score"], rival - 2.0, rival / 1.25)).otherwise(x["score"]).alias("score"), x["diversity"])
    return bound(scores, lambda s: bound(rivals(s), lambda r: F.transform(s, lambda x: held(x, r))))


def understood(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sections``, ``signals``, ``scores`` and ``classification``, each from those before it; null for null texts."""
    t = F.col(text)
    there = lambda c: F.when(t.isNotNull(), c)
    out = with_worked_out(docs, sections=there(sections_of(t)))
    out = with_worked_out(out, signals=there(radiology.own_signals(t, F.col("sections"))))
    out = with_worked_out(out, scores=there(scores_of(t, F.col("sections"), F.col("signals"))))
    return with_worked_out(out, classification=there(classification(F.col("scores"), F.col("sections"), F.col("signals"))))


def profile_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, domain, document_type, score, diversity) of every text and profile."""
    made = understood(docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text")))
    return made.select(key, F.inline("scores")).drop("place")


def confidence(score: Column, margin: Column, diversity: Column) -> Column:
    part = lambda x, most: F.least(x / most, F.lit(1.0))
    return F.round(0.45 * part(score, 12.0) + 0.25 * part(diversity, 3.0) + 0.3 * part(F.greatest(margin, F.lit(0.0)), 6.0), 3)


def classification(scores: Column, sections: Column, signals: Column, least: float = 5.0, margin: float = 2.0, ratio: float = 1.25) -> Column:
    """struct<domain, document_type, subtype, confidence, confidence_band, nature>: the best profile if it is good enough and clear of the second, else unknown.

    Ties go to the profile that comes first. Subtype and nature are those of radiology reports.
    """
    ordered = F.array_sort(F.transform(scores, lambda x: F.struct((-x["score"]).alias("s"), x["place"].alias("place"), x["domain"].alias("domain"), x["document_type"].alias("kind"), x["diversity"].alias("diversity"))))
    return bound(ordered, lambda o: _told(o, sections, signals, least, margin, ratio))


def _told(ordered: Column, sections: Column, signals: Column, least: float, margin: float, ratio: float) -> Column:
    first = ordered[0]
    best, second = -first["s"], -ordered[1]["s"]
    sure = confidence(best, best - second, first["diversity"])
    clear = (best >= least) & (best - second >= margin) & (best >= ratio * second)
    band = F.when(best <= 0, "UNKNOWN").when(~clear, "LOW").when(sure >= 0.8, "HIGH").when(sure >= 0.58, "MEDIUM").otherwise("LOW")
    named = clear & band.isin("HIGH", "MEDIUM")
    own = named & (first["domain"] == "radiology")
    value = F.when(best <= 0, F.lit(0.0)).when(~clear, F.least(sure, F.lit(0.49))).otherwise(sure)
    told = lambda c, yes: F.when(c, yes)
    return F.struct(
        told(named, first["domain"]).otherwise("unknown").alias("domain"), told(named, first["kind"]).otherwise("unknown").alias("document_type"), told(own, radiology.modality(signals)).otherwise("UNKNOWN").alias("subtype"),
        value.alias("confidence"), band.alias("confidence_band"), told(own, radiology.nature(signals, sections)).otherwise("UNKNOWN").alias("nature"),
    )


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, domain, document_type, subtype, confidence, confidence_band, nature) of every text."""
    return understood(docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text"))).select(key, "classification.*")


def contexts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, language, classification, route, clinical (radiology reports only), roles and privacy regions of the sections: one row for each text."""
    made = understood(docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text")))
    c = F.col("classification")
    roles = F.transform("sections", lambda x: F.struct(x["canonical_name"].alias("section"), radiology.semantic_role(x["canonical_name"]).alias("role"), x["original_heading"].alias("heading"), x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos")))
    private = F.filter(F.transform("sections", lambda x: F.struct(radiology.privacy_role(x["canonical_name"]).alias("role"), x["canonical_name"].alias("section"), x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"))), lambda x: x["role"].isNotNull())
    clinical = F.when(c["domain"] == "radiology", radiology.clinical_context(F.col("signals")))
    return made.select(
        key, script_language(F.col("text")).alias("language"), c.alias("classification"), routing(c["document_type"], c["confidence_band"]).alias("route"), clinical.alias("clinical"), roles.alias("sections"), private.alias("privacy"),
        F.octet_length("text").alias("file_size"), stable_hash(F.col("text"), 32).alias("content_id"),
    )


# What follows for each domain.
ROUTES = {"pathology": "pathology", "laboratory": "laboratory", "radiology": "radiology", "emergency": "emergency", "admission_discharge": "admission", "public_health": "public_health"}


def route(domain: Column, band: Column) -> Column:
    """The extraction that a document goes to; manual review if it is unknown or unsure."""
    known = F.create_map(*[F.lit(x) for k, v in ROUTES.items() for x in (k, v + "_extraction")])[F.lower(domain)]
    return F.when(F.upper(band).isin("LOW", "UNKNOWN") | band.isNull(), "manual_review").otherwise(F.coalesce(known, F.lit("manual_review")))


# The extraction and terminology of each type of document.
ROUTES_OF_TYPES = {
    "radiology_report": ("radiology_extraction", "radiology_terminology"), "pathology_report": ("pathology_extraction", "pathology_terminology"), "laboratory_report": ("laboratory_extraction", "laboratory_terminology"),
    "emergency_report": ("emergency_extraction", "emergency_terminology"), "admission_note": ("admission_extraction", "general_clinical_terminology"), "discharge_summary": ("discharge_extraction", "general_clinical_terminology"),
    "public_health_document": ("public_health_extraction", "public_health_terminology"),
}


def routing(document_type: Column, band: Column) -> Column:
    """struct<privacy_profile, extraction, terminology, capabilities, manual_review> for a type of document; manual review if it is unknown or unsure."""
    kind = F.lower(document_type)
    manual = ~F.coalesce(kind.isin(*ROUTES_OF_TYPES), F.lit(False)) | F.upper(band).isin("LOW", "UNKNOWN") | band.isNull()
    part = lambda i, other: F.when(manual, other).otherwise(lookup({k: v[i] for k, v in ROUTES_OF_TYPES.items()}, kind, other))
    able = F.when(manual, F.array(F.lit("PROTECT"))).otherwise(F.array(F.lit("PROTECT"), F.lit("EXTRACT"), F.lit("STANDARDIZE")))
    return F.struct(F.lit("clinical").alias("privacy_profile"), part(0, "manual_review").alias("extraction"), part(1, "general_clinical_terminology").alias("terminology"), able.alias("capabilities"), manual.alias("manual_review"))
