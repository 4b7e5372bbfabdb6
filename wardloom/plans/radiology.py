"""What a radiology report says: signals of its concepts, the gates and score of the domain, its modality, nature and clinical context.

Signals stay an array in their document's row, so that nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardloom.functions.scalars import bound, lookup
from wardloom.operators.spans import SPANS, located
from wardloom.operators.terms import quoted

#: Families of signals in their fixed order, those that give context, and those that score.
FAMILIES = ("domain", "modality", "technique", "acquisition", "anatomy", "procedure", "contrast", "structure", "clinical_purpose", "professional_role", "conflicting")
CONTEXT_FAMILIES = ("technique", "acquisition", "anatomy", "contrast", "structure", "professional_role")
SCORED_FAMILIES = ("domain", "modality", "technique", "acquisition", "anatomy", "contrast", "structure", "professional_role")
# Concepts by family: id, name, weight, and the words that stand for it.
CONCEPTS = {
    "domain": [
        ("RAD_DOC_REPORT", "Radiology report", 5.0, "radiology report|تقرير الأشعة|imaging report"), ("RAD_SERVICE_CONTEXT", "Radiology service", 4.0, "radiology department|قسم الأشعة"),
    ],
    "professional_role": [("RAD_AUTHOR_RADIOLOGIST", "Radiologist", 2.0, "radiologist|طبيب الأشعة|اختصاصي الأشعة|أخصائي الأشعة")],
    "modality": [
        ("RAD_MODALITY_CT", "Computed tomography", 2.0, "CT|أشعة مقطعية|computed tomography|التصوير المقطعي"),
        ("RAD_MODALITY_MRI", "Magnetic resonance imaging", 2.0, "MRI|الرنين المغناطيسي|magnetic resonance|التصوير بالرنين المغناطيسي"),
        ("RAD_MODALITY_XRAY", "X-ray", 2.0, "x-ray|أشعة سينية|x ray|radiograph"), ("RAD_MODALITY_ULTRASOUND", "Ultrasound", 2.0, "ultrasound|الموجات فوق الصوتية|sonography|الألتراساوند"),
        ("RAD_MODALITY_DOPPLER", "Doppler ultrasound", 2.0, "Doppler|دوبلر|Doppler ultrasound|duplex ultrasound"), ("RAD_MODALITY_MAMMOGRAPHY", "Mammography", 2.0, "mammography|تصوير الثدي|mammogram|الماموجرام"),
        ("RAD_MODALITY_NUCLEAR_MEDICINE", "Nuclear medicine", 2.0, "nuclear medicine|pet scan|scintigraphy"),
    ],
    "technique": [
        ("RAD_TECH_T1", "T1-weighted imaging", 1.0, "T1-weighted|T1 weighted|T1WI|T1"), ("RAD_TECH_T2", "T2-weighted imaging", 1.0, "T2-weighted|T2 weighted|T2WI|T2"),
        ("RAD_TECH_FLAIR", "FLAIR imaging", 1.0, "FLAIR"), ("RAD_TECH_STIR", "STIR imaging", 1.0, "STIR"),
        ("RAD_TECH_DWI", "Diffusion-weighted imaging", 1.3, "diffusion-weighted|diffusion weighted|DWI|ADC"),
        ("RAD_TECH_FAT_SUPPRESSION", "Fat-suppressed imaging", 1.0, "fat saturation|fat-suppressed|fat suppressed|fat suppression"),
    ],
    "acquisition": [
        ("RAD_ACQ_MULTIPLANAR", "Multiplanar imaging", 1.0, "multiplanar|axial|sagittal|coronal"), ("RAD_ACQ_SCANNER", "MRI scanner field strength", 1.0, "Tesla|1.5T|3T|MR scanner"),
    ],
    "anatomy": [
        ("RAD_ANAT_HEAD", "Head", 1.0, "head"), ("RAD_ANAT_BRAIN", "Brain", 1.0, "brain"), ("RAD_ANAT_NECK", "Neck", 1.0, "neck"), ("RAD_ANAT_CHEST", "Chest", 1.0, "chest|thorax|الصدر|صدرية"),
        ("RAD_ANAT_ABDOMEN", "Abdomen", 1.0, "abdomen|abdominal|البطن"), ("RAD_ANAT_PELVIS", "Pelvis", 1.0, "pelvis|pelvic|الحوض"), ("RAD_ANAT_SPINE", "Spine", 1.0, "spine"), ("RAD_ANAT_BREAST", "Breast", 1.0, "breast"),
        ("RAD_ANAT_EXTREMITY", "Extremity", 1.0, "extremity|limb"), ("RAD_ANAT_WHOLE_BODY", "Whole body", 1.0, "whole body"),
    ],
    "contrast": [
        ("RAD_CONTRAST_WITH", "With contrast", 1.0, "with contrast|post-contrast|post contrast|contrast-enhanced|after contrast|بالصبغة|مع الصبغة|بعد حقن الصبغة"),
        ("RAD_CONTRAST_WITHOUT", "Without contrast", 1.0, "without contrast|non-contrast|pre-contrast|pre contrast|بدون صبغة"),
        ("RAD_CONTRAST_PRE_POST", "Pre/post contrast", 1.5, "pre/post contrast|pre- and post-contrast|before and after contrast|without and with contrast"),
    ],
    "clinical_purpose": [
        ("RAD_PURPOSE_STAGING", "Oncologic staging", 1.2, "cancer staging|oncologic staging|tumor staging|tumour staging|staging"), ("RAD_PURPOSE_SCREENING", "Screening", 1.0, "screening"),
        ("RAD_PURPOSE_FOLLOWUP", "Follow-up", 1.0, "follow-up|follow up|surveillance"), ("RAD_PURPOSE_POST_TREATMENT", "Post-treatment assessment", 1.0, "post-treatment|treatment response"),
        ("RAD_PURPOSE_DIAGNOSTIC", "Diagnostic evaluation", 1.0, "diagnostic evaluation"),
    ],
}
# Sections that are signals of structure, and their weight.
SECTION_CONCEPTS = {
    "procedure_information": ("RAD_SECTION_PROCEDURE_INFO", "Procedure information", 1.5), "radiology_examination": ("RAD_SECTION_EXAMINATION", "Radiology examination", 2.0),
    "technique": ("RAD_SECTION_TECHNIQUE", "Technique", 2.0), "findings": ("RAD_SECTION_FINDINGS", "Findings", 2.0), "impression": ("RAD_SECTION_IMPRESSION", "Impression", 3.0),
    "comparison": ("RAD_SECTION_COMPARISON", "Comparison", 1.5), "clinical_information": ("RAD_SECTION_CLINICAL_INFO", "Clinical information", 1.5),
}
# Modalities, body regions and techniques by concept; purposes and families of imported concepts.
MODALITIES = {"RAD_MODALITY_MRI": "MRI", "RAD_MODALITY_CT": "CT", "RAD_MODALITY_XRAY": "X_RAY", "RAD_MODALITY_ULTRASOUND": "ULTRASOUND", "RAD_MODALITY_DOPPLER": "DOPPLER", "RAD_MODALITY_MAMMOGRAPHY": "MAMMOGRAPHY", "RAD_MODALITY_NUCLEAR_MEDICINE": "NUCLEAR_MEDICINE"}
REGIONS = {c: c[9:] for c, *_ in CONCEPTS["anatomy"]}
TECHNIQUES = {c: n for c, n, *_ in [*CONCEPTS["technique"], CONCEPTS["acquisition"][0]]}
PURPOSES = [
    ("RAD_PURPOSE_STAGING", "Oncologic Staging"), ("RAD_PURPOSE_SCREENING", "Screening"), ("RAD_PURPOSE_POST_TREATMENT", "Post-treatment Assessment"),
    ("RAD_PURPOSE_FOLLOWUP", "Follow-up / Surveillance"), ("RAD_PURPOSE_DIAGNOSTIC", "Diagnostic Evaluation"),
]
FAMILY_OF_IMPORTED = {
    "DOCUMENT_REPORT": "domain", "IMAGING_MODALITY": "modality", "MODALITY_SUBTYPE": "modality", "IMAGING_TECHNIQUE": "technique", "ACQUISITION": "acquisition", "BODY_REGION": "anatomy", "IMAGING_FOCUS": "anatomy",
    "IMAGING_PROCEDURE": "procedure", "CONTRAST": "contrast", "PHARMACEUTICAL": "contrast", "CLINICAL_PURPOSE": "clinical_purpose", "REASON_FOR_EXAM": "clinical_purpose", "PROFESSIONAL_ROLE": "professional_role",
    "IMAGING_OBSERVATION": "clinical_purpose", "CLINICAL_FINDING": "clinical_purpose",
}
SECTION_ROLES = {
    "patient_information": "Patient / Administrative Information", "procedure_information": "Procedure Information", "radiology_examination": "Examination", "clinical_history": "Clinical Indication",
    "clinical_information": "Clinical Information", "technique": "Technique", "findings": "Findings", "impression": "Impression", "radiologist_authentication": "Radiologist / Authentication",
}
PRIVACY_ROLES = {"patient_information": "likely_identifier_bearing", "radiologist_authentication": "provider_authentication", "authorization": "provider_authentication"}
REPORT_SIGNATURE = {
    "identity": ["RAD_DOC_REPORT", "RAD_SERVICE_CONTEXT"], "structural": ["RAD_SECTION_EXAMINATION", "RAD_SECTION_TECHNIQUE", "RAD_SECTION_FINDINGS", "RAD_SECTION_IMPRESSION"],
    "supporting": ["RAD_AUTHOR_RADIOLOGIST", "RAD_MODALITY_CT", "RAD_MODALITY_MRI", "RAD_MODALITY_XRAY", "RAD_MODALITY_ULTRASOUND", "RAD_MODALITY_MAMMOGRAPHY", "RAD_MODALITY_NUCLEAR_MEDICINE"],
}
NAMES = {c: n for rows in CONCEPTS.values() for c, n, *_ in rows} | {c: n for c, n, _ in SECTION_CONCEPTS.values()}
ALIASES = {c: a.split("|") for rows in CONCEPTS.values() for c, _, _, a in rows}
SIGNAL = "struct<family:string,concept_id:string,value:string,start_pos:int,end_pos:int,strength:double,context:string,provenance:array<string>,mappings:array<struct<source_id:string,external_id:string>>,relationships:array<struct<type:string,target:string>>>"
NOT_WORD = r"[\p{L}\p{N}_]"


def line_around(text: Column, start: Column, end: Column) -> Column:
    """The line, or lines, that a span stands in, without blanks at the ends."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    return F.trim(F.concat(F.substring_index(before, "\n", -1), F.substring(text, start + 1, end - start), F.substring_index(after, "\n", 1)))


def signal(family: Column, concept: Column, value: Column, start: Column, end: Column, strength: Column, text: Column, provenance: Column | None = None, mappings: Column | None = None, relationships: Column | None = None) -> Column:
    none = F.array()
    return F.struct(
        family.alias("family"), concept.alias("concept_id"), value.alias("value"), start.alias("start_pos"), end.alias("end_pos"), strength.cast("double").alias("strength"), line_around(text, start, end).alias("context"),
        (none if provenance is None else provenance).cast("array<string>").alias("provenance"), (none if mappings is None else mappings).cast("array<struct<source_id:string,external_id:string>>").alias("mappings"),
        (none if relationships is None else relationships).cast("array<struct<type:string,target:string>>").alias("relationships"),
    )


def word_pattern(words: Sequence[str]) -> str:
    return rf"(?iu)(?<!{NOT_WORD})(?:{'|'.join(map(quoted, sorted(words, key=lambda w: (-len(w), w))))})(?!{NOT_WORD})"


def own_signals(text: Column, sections: Column) -> Column:
    """Signals of the built-in concepts: their words in the text, each place once for a concept with the longest word that stands there, and the sections of a report.

    ``sections`` is an array of structs with canonical_name, original_heading and start_pos.
    """
    ids = {s: c for s, (c, _, _) in SECTION_CONCEPTS.items()}
    weights = {s: w for s, (_, _, w) in SECTION_CONCEPTS.items()}
    known = F.filter(sections, lambda x: x["canonical_name"].isin(*ids))
    end = lambda x: x["start_pos"] + F.length(x["original_heading"])
    made = F.transform(known, lambda x: signal(F.lit("structure"), lookup(ids, x["canonical_name"], ""), x["original_heading"], x["start_pos"], end(x), lookup(weights, x["canonical_name"], 0.0), text))
    found = {f: [_located_signals(text, f, c, w, words) for c, _, w, words in rows] for f, rows in CONCEPTS.items()} | {"structure": [made]}
    return F.concat(*[x for f in FAMILIES for x in found.get(f, ())])


def may_hold(text: Column, words: Sequence[str]) -> Column:
    """Whether the first part of any of the words stands in a text: a quick test that each match of ``word_pattern`` passes."""
    low, out = F.lower(text), None
    for part in dict.fromkeys(w.lower().split()[0] for w in words):
        out = F.contains(low, F.lit(part)) if out is None else out | F.contains(low, F.lit(part))
    return out


def _located_signals(text: Column, family: str, concept: str, strength: float, words: str) -> Column:
    held = F.when(may_hold(text, words.split("|")), located(text, word_pattern(words.split("|")))).otherwise(F.array().cast(SPANS))
    return F.transform(held, lambda x: signal(F.lit(family), F.lit(concept), x["value"], x["start_pos"], x["end_pos"], F.lit(strength), text))


def with_imported(signals: Column, imported: Column, text: Column, strength: float = 0.75) -> Column:
    """``signals`` with those of imported concepts (array of structs with concept_id, concept_family, start_pos, end_pos, found, provenance, mappings, relationships).

    Where a signal of the same family has the same span, it takes the provenance, mappings and relationships instead.
    """
    fits = F.filter(imported, lambda x: x["concept_family"].isin(*FAMILY_OF_IMPORTED) & (F.length(x["found"]) >= 3))
    made = F.transform(fits, lambda x: signal(lookup(FAMILY_OF_IMPORTED, x["concept_family"], ""), x["concept_id"], x["found"], x["start_pos"], x["end_pos"], F.lit(strength), text, x["provenance"], x["mappings"], x["relationships"]))
    same = lambda a, b: (a["family"] == b["family"]) & (a["start_pos"] == b["start_pos"]) & (a["end_pos"] == b["end_pos"])

    def step(a: Column, x: Column) -> Column:
        first = F.array_position(F.transform(a, lambda y: same(y, x)), F.lit(True))
        joined = F.transform(a, lambda y, i: F.when(i == first - 1, _enriched(y, x)).otherwise(y))
        return F.when(first > 0, joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(made, signals, step)


def _enriched(y: Column, x: Column) -> Column:
    more = {c: F.array_distinct(F.concat(y[c], x[c])) for c in ("provenance", "mappings", "relationships")}
    return F.struct(*[(more[c] if c in more else y[c]).alias(c) for c in ("family", "concept_id", "value", "start_pos", "end_pos", "strength", "context", "provenance", "mappings", "relationships")])


def ids(signals: Column, *families: str) -> Column:
    return F.array_distinct(F.transform(F.filter(signals, lambda x: x["family"].isin(*families)), lambda x: x["concept_id"]))


def has_family(signals: Column, family: str) -> Column:
    return F.exists(signals, lambda x: x["family"] == family)


def families_present(signals: Column, families: Sequence[str]) -> Column:
    return sum((has_family(signals, f).cast("int") for f in families), F.lit(0))


def domain_satisfied(signals: Column) -> Column:
    """Whether the signals cohere: a modality with techniques or context, an explicit report with context, or three sections with a modality or a radiologist."""
    methods, context = F.size(ids(signals, "technique", "acquisition")), families_present(signals, CONTEXT_FAMILIES)
    coherent = has_family(signals, "modality") & ((methods >= 2) | (context >= 3))
    structural = (F.size(ids(signals, "structure")) >= 3) & (has_family(signals, "modality") | has_family(signals, "professional_role"))
    return coherent | (has_family(signals, "domain") & (context >= 1)) | structural


def report_satisfied(signals: Column) -> Column:
    has = lambda c: F.array_contains(ids(signals, "structure"), c)
    explicit = has("RAD_SECTION_FINDINGS") & has("RAD_SECTION_IMPRESSION")
    implied = has("RAD_SECTION_IMPRESSION") & has_family(signals, "professional_role") & has_family(signals, "modality") & (F.size(ids(signals, "technique", "acquisition")) >= 2)
    return domain_satisfied(signals) & (explicit | implied | F.array_contains(ids(signals, "domain"), "RAD_DOC_REPORT"))


def modality(signals: Column) -> Column:
    """The one modality of a document; UNKNOWN if there are several or none. Doppler is no second ultrasound; three techniques without a modality mean MRI."""
    named = F.filter(F.transform(ids(signals, "modality"), lambda c: lookup(MODALITIES, c, None)), lambda m: m.isNotNull())
    told = F.when(F.array_contains(named, "DOPPLER"), F.array_remove(named, "ULTRASOUND")).otherwise(named)
    return F.when(F.size(told) == 1, told[0]).when((F.size(told) == 0) & (F.size(ids(signals, "technique", "acquisition")) >= 3), "MRI").otherwise("UNKNOWN")


def coherent_relationships(signals: Column) -> Column:
    """The distinct pairs of concepts of which one names the other as its target and both stand in the text."""
    pairs = F.flatten(F.transform(signals, lambda x: F.transform(x["relationships"], lambda r: F.struct(x["concept_id"].alias("a"), r["target"].alias("b")))))
    return bound(F.transform(signals, lambda x: x["concept_id"]), lambda present: F.array_distinct(F.filter(pairs, lambda p: F.array_contains(present, p["b"]))))


def score(signals: Column) -> Column:
    """The strongest signal of each concept summed over the families that score, a point for each family beyond two, and up to two for relationships."""
    counting = F.filter(signals, lambda x: x["family"].isin(*SCORED_FAMILIES))
    strongest = lambda s, k: F.array_max(F.transform(F.filter(s, lambda x: (x["family"] == k["f"]) & (x["concept_id"] == k["c"])), lambda x: x["strength"]))
    per = bound(counting, lambda s: F.transform(F.array_distinct(F.transform(s, lambda x: F.struct(x["family"].alias("f"), x["concept_id"].alias("c")))), lambda k: strongest(s, k)))
    diversity = families_present(signals, SCORED_FAMILIES)
    return F.round(F.aggregate(per, F.lit(0.0), lambda a, x: a + x) + F.greatest(F.lit(0), diversity - 2) + F.least(F.lit(2.0), F.size(coherent_relationships(signals)) * 0.25), 2)


def nature(signals: Column, sections: Column) -> Column:
    """What kind of document it is: a template with several modalities, a completed or a partial report."""
    names = F.array_distinct(F.transform(sections, lambda x: x["canonical_name"]))
    return (
        F.when((F.size(ids(signals, "modality")) > 1) & (F.size(names) >= 3), "STRUCTURED_TEMPLATE").when(F.array_contains(names, "findings") & F.array_contains(names, "impression"), "COMPLETED_REPORT")
        .when(domain_satisfied(signals) & (F.size(names) > 0), "PARTIAL_REPORT").otherwise("UNKNOWN")
    )


def signed(signals: Column, signature: dict[str, list[str]] = REPORT_SIGNATURE) -> Column:
    """Whether the concepts of a text bear a signature: identity with structure or support, or three of its structure with support."""
    present = F.transform(signals, lambda x: x["concept_id"])
    n = {k: F.size(F.array_intersect(present, F.array(*map(F.lit, v)))) for k, v in signature.items()}
    return ((n["identity"] > 0) & ((n["structural"] > 0) | (n["supporting"] > 0))) | ((n["structural"] >= 3) & (n["supporting"] > 0))


def distance(x: Column, y: Column) -> Column:
    return F.greatest(x["start_pos"] - y["end_pos"], y["start_pos"] - x["end_pos"], F.lit(0))


def regions(signals: Column) -> Column:
    """The body regions of a text, the nearest to a modality first, then in order."""
    spots = F.filter(signals, lambda x: x["family"] == "modality")
    broad = F.filter(signals, lambda x: x["concept_id"].isin(*REGIONS))
    ranked = F.array_sort(F.transform(broad, lambda x: F.struct(F.coalesce(F.array_min(F.transform(spots, lambda m: distance(m, x))), F.lit(0)).alias("d"), F.when(F.size(spots) > 0, x["start_pos"]).otherwise(0).alias("s"), x["concept_id"].alias("c"))))
    # without a modality they keep the order of their concepts
    kept = F.when(F.size(spots) > 0, F.transform(ranked, lambda r: r["c"])).otherwise(F.transform(broad, lambda x: x["concept_id"]))
    return F.array_distinct(F.transform(kept, lambda c: lookup(REGIONS, c, "")))


def fine_anatomy(signals: Column, most: int = 120) -> Column:
    """The imported anatomy nearest to the first modality, the longest first, at most ``most`` signs away; its concept id."""
    spots = F.filter(signals, lambda x: x["family"] == "modality")
    first = F.array_min(F.transform(spots, lambda m: F.struct(m["start_pos"].alias("start_pos"), m["end_pos"].alias("end_pos"))))
    fine = F.filter(signals, lambda x: (x["family"] == "anatomy") & ~x["concept_id"].isin(*REGIONS))
    ranked = F.array_min(F.transform(fine, lambda x: F.struct(distance(first, x).alias("d"), (x["start_pos"] - x["end_pos"]).alias("w"), x["start_pos"].alias("s"), x["concept_id"].alias("c"))))
    return F.when(ranked["d"] <= most, ranked["c"])


def contrast(signals: Column) -> Column:
    has = lambda c: F.array_contains(ids(signals, "contrast"), c)
    both = has("RAD_CONTRAST_PRE_POST") | (has("RAD_CONTRAST_WITH") & has("RAD_CONTRAST_WITHOUT"))
    return F.when(both, "PRE_AND_POST_CONTRAST").when(has("RAD_CONTRAST_WITH"), "WITH_CONTRAST").when(has("RAD_CONTRAST_WITHOUT"), "WITHOUT_CONTRAST")


def purpose(signals: Column) -> Column:
    """The first purpose of the fixed order that stands in the text."""
    out: object = F
    for concept, label in PURPOSES:
        out = out.when(F.array_contains(ids(signals, "clinical_purpose"), concept), label)
    return out


def techniques(signals: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(ids(signals, "technique", "acquisition"), lambda c: c.isin(*TECHNIQUES)), lambda c: lookup(TECHNIQUES, c, "")))


def clinical_context(signals: Column) -> Column:
    """struct of modality, examination, body region and regions, contrast, techniques, purpose, concepts, fine anatomy and the number of families."""
    kind, where = F.nullif(modality(signals), F.lit("UNKNOWN")), regions(signals)
    label = F.array_join(F.transform(where, lambda r: F.replace(F.initcap(F.replace(F.lower(r), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))), " & ")
    named = F.array_distinct(F.filter(F.transform(signals, lambda x: lookup(NAMES, x["concept_id"], None)), lambda n: n.isNotNull()))
    return F.struct(
        kind.alias("modality"), F.nullif(F.concat_ws(" ", kind, F.nullif(label, F.lit(""))), F.lit("")).alias("examination"), F.get(where, F.lit(0)).alias("region"), where.alias("regions"), contrast(signals).alias("contrast"),
        techniques(signals).alias("techniques"), purpose(signals).alias("purpose"), named.alias("concepts"), fine_anatomy(signals).alias("fine_anatomy"), families_present(signals, FAMILIES).alias("families"),
    )


def semantic_role(section: Column) -> Column:
    return F.coalesce(lookup(SECTION_ROLES, section, None), F.initcap(F.replace(section, F.lit("_"), F.lit(" "))))


def privacy_role(section: Column) -> Column:
    """What a section means for privacy; null for most."""
    return lookup(PRIVACY_ROLES, section, None)
