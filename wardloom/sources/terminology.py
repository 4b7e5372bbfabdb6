"""Terminologies from their public exchange formats into the concept model, and versions of them in a store."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.scalars import lookup
from wardloom.operators.concepts import MAPPING, RELATIONSHIP, ancestors, term_key
from wardloom.session import cut


def _column(df: DataFrame, *names: str) -> Column:
    """The first non-blank of the columns that bear one of the names, whatever their case and signs."""
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    by = {plain(c): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{by[plain(n)]}`")), F.lit("")) for n in names if plain(n) in by]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def columns(df: DataFrame) -> Callable[..., Column]:
    """The getter of a table's columns by any of their names."""
    return lambda *names: _column(df, *names)


def members(spark: SparkSession, path: str, name: str) -> list[str]:
    """The files of an artifact whose name matches a pattern: the file itself, those below a folder, or those inside of ZIP archives there.

    Members of archives are unpacked by an executor beside the archive, into a folder of its name with ``.d`` after it. The names of an artifact's files are few.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    names = [r.path for r in found.select("path").collect()]

    def unpack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for p, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    out += [(p, n, z.read(n)) for n in z.namelist() if re.search(name, n, re.I)]
            yield pd.DataFrame(out, columns=["archive", "member", "content"])

    zips = [n for n in names if n.lower().endswith(".zip")]
    out = [n for n in names if re.search(name, n, re.I)]
    if zips:
        content = spark.read.format("binaryFile").load(zips).select("path", "content").mapInPandas(unpack, "archive string, member string, content binary")
        for r in content.collect():  # members that match: a few tables of one artifact
            target = Path(r.archive.removeprefix("file:") + ".d") / r.member
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(bytes(r.content))
            out.append(str(target))
    return sorted(out)


def table_of(spark: SparkSession, path: str, name: str, sep: str = ",") -> DataFrame | None:
    """The table of an artifact in files whose name matches, with a header; None if there is none."""
    files = members(spark, path, name)
    return spark.read.csv(files, header=True, multiLine=True, escape='"', sep=sep, encoding="UTF-8") if files else None


def concept(prefix: str, parts: Sequence[Column], name: Column, family: Column, source: str, mappings: Column, synonyms: Column | None = None, relationships: Column | None = None, attributes: Column | None = None, status: Column | None = None) -> list[Column]:
    """The columns of an imported concept; its id is made of the folded forms of ``parts`` that aren't empty."""
    key = F.array_join(F.filter(F.array(*[term_key(p) for p in parts]), lambda x: x.isNotNull() & (x != "")), "|")
    identity = F.concat(F.lit(prefix + "_"), F.upper(F.substring(F.sha2(key, 256), 1, 16)))
    none = F.array().cast("array<string>")
    return [
        identity.alias("concept_id"), name.alias("canonical_name"), family.alias("concept_family"), F.lit("RADIOLOGY").alias("domain"), F.array(name).alias("preferred_terms"),
        F.coalesce(none if synonyms is None else F.array_distinct(F.filter(synonyms, lambda x: (x != "") & (x != name))), none).alias("synonyms"), F.array(F.lit("en")).alias("languages"),
        F.array_distinct(mappings).cast(f"array<{MAPPING}>").alias("mappings"), F.coalesce(F.array() if relationships is None else relationships, F.array()).cast(f"array<{RELATIONSHIP}>").alias("relationships"),
        F.array(F.lit(source)).alias("provenance"), F.coalesce(F.lit(None).cast("string") if status is None else status, F.lit("ACTIVE")).alias("status"),
        F.map_filter(F.create_map(F.lit(""), F.lit("")) if attributes is None else attributes, lambda k, v: v.isNotNull() & (k != "")).alias("attributes"),
    ]


def mapping(source: Column, external: Column, display: Column, kind: str | Column = "EXACT") -> Column:
    return F.struct(source.alias("source_id"), external.alias("external_id"), display.alias("display"), (F.lit(kind) if isinstance(kind, str) else kind).alias("mapping_type"))


def relationship(kind: str, target: Column, source: str, source_relationship: Column, order: Column, external: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), target.alias("target"), F.array(F.lit(source)).alias("sources"), source_relationship.alias("source_relationship"), order.alias("sequence_order"), external.alias("external_id"))


# Families of the kinds of parts that procedures are made of.
PART_FAMILIES = {
    "MODALITY": "IMAGING_MODALITY", "MODALITY_SUBTYPE": "MODALITY_SUBTYPE", "REGION_IMAGED": "BODY_REGION", "IMAGING_FOCUS": "IMAGING_FOCUS", "LATERALITY": "LATERALITY", "VIEW": "VIEW", "TIMING": "TIMING",
    "PHARMACEUTICAL": "PHARMACEUTICAL", "ROUTE": "ROUTE", "GUIDANCE": "GUIDANCE", "MANEUVER": "MANEUVER", "REASON_FOR_EXAM": "REASON_FOR_EXAM",
}
RADLEX, SNOMED = "RADLEX_CURRENT", "SNOMED_INT_20260701"


def _typed(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[ .]", "_"))


def parts_of(uses: DataFrame, catalog: DataFrame | None, related: DataFrame | None, source: str) -> DataFrame:
    """Concepts of the distinct parts in ``uses`` (number, type, name, rid, rid_name), with ``number``.

    The catalog's last row for a number names it; related codes become mappings. Both are joined by the number.
    """
    one = uses.groupBy("number").agg(*[F.min(c).alias(c) for c in ("type", "name")], F.sort_array(F.collect_set(F.when(F.col("rid").isNotNull(), F.struct("rid", "rid_name")))).alias("rids"))
    if catalog is not None:
        c = columns(catalog)
        rows = catalog.select(c("PartNumber").alias("number"), c("PartName").alias("o_name"), c("PartDisplayName").alias("o_display"), c("PartTypeName").alias("o_type"), c("Status").alias("o_status"), F.monotonically_increasing_id().alias("seq"))
        last = rows.where("number is not null").groupBy("number").agg(F.max_by(F.struct("o_name", "o_display", "o_type", "o_status"), "seq").alias("o")).select("number", "o.*")
        one = one.join(last, "number", "left")
    else:
        one = one.select("*", *[F.lit(None).cast("string").alias(c) for c in ("o_name", "o_display", "o_type", "o_status")])
    empty = F.array().cast(f"array<{MAPPING}>")
    if related is not None:
        c = columns(related)
        system = F.lower(F.coalesce(c("ExtCodeSystem"), F.lit("")))
        of = F.when(F.contains(system, F.lit("radlex.org")), RADLEX).when(F.contains(system, F.lit("snomed.info")), SNOMED).otherwise(F.concat(F.lit("LOINC_RELATED:"), F.coalesce(c("ExtCodeSystem"), F.lit(""))))
        codes = related.select(c("PartNumber").alias("number"), mapping(of, c("ExtCodeId"), F.coalesce(c("ExtCodeDisplayName"), F.lit("")), F.coalesce(c("Equivalence"), F.lit("LOINC_PART_RELATED_CODE"))).alias("m")).where("number is not null and m.external_id is not null")
        one = one.join(codes.groupBy("number").agg(F.sort_array(F.collect_set("m")).cast(f"array<{MAPPING}>").alias("related")), "number", "left")
    else:
        one = one.withColumn("related", empty)
    name, kind = F.coalesce("o_name", "name", "number"), _typed(F.coalesce("o_type", "type", F.lit("")))
    rids = F.transform("rids", lambda x: mapping(F.lit(RADLEX), x["rid"], F.coalesce(x["rid_name"], name), "AUTHORITATIVE_PLAYBOOK"))
    maps = F.concat(F.array(mapping(F.lit(source), F.col("number"), name)).cast(f"array<{MAPPING}>"), F.coalesce("related", empty), rids.cast(f"array<{MAPPING}>"))
    attributes = F.create_map(F.lit("record_type"), F.lit("LOINC_PART"), F.lit("part_type"), kind)
    synonyms = F.filter(F.array("o_display", "name"), lambda x: x.isNotNull())
    return one.select("number", *concept("LOINC_PART", [kind, F.col("number"), name], name, lookup(PART_FAMILIES, kind, "PROCEDURE_ATTRIBUTE"), source, maps, synonyms, attributes=attributes, status=F.col("o_status")))


def _composed(uses: DataFrame, parts: DataFrame, source: str) -> DataFrame:
    """(code, relationships) of what is made of parts; ``uses`` has code, number, type, order."""
    edge = relationship("CAN_COMPOSE", F.col("concept_id"), source, F.col("type"), F.col("order"), F.col("number"))
    return uses.join(parts.select("number", "concept_id"), "number").groupBy("code").agg(F.sort_array(F.collect_set(F.struct(F.col("order").try_cast("int").alias("o"), edge.alias("e")))).alias("r")).select("code", F.transform("r", lambda x: x["e"]).alias("relationships"))


def loinc(spark: SparkSession, path: str, source: str = "LOINC_RSNA") -> DataFrame:
    """Concepts of a radiology playbook and its document ontology: procedures, parts and documents, with what each is made of.

    Reads the playbook, the part catalog, related codes, the document ontology, imaging documents and the main table from a
    folder or its archives. Without a playbook there is an error.
    """
    book = table_of(spark, path, r"LoincRsnaRadiologyPlaybook\.csv$")
    if book is None:
        raise ValueError("no radiology playbook in the artifact")
    b = columns(book)
    rows = book.select(
        b("LoincNumber", "LOINC_NUM", "LOINC").alias("code"), b("LongCommonName", "LONG_COMMON_NAME", "LongName").alias("long_name"), b("PartNumber").alias("number"), _typed(b("PartTypeName")).alias("type"),
        b("PartName", "PreferredName").alias("name"), b("PartSequenceOrder").alias("order"), b("RID").alias("rid"), b("PreferredName").alias("rid_name"), b("RPID").alias("rpid"), b("LongName").alias("rpid_name"),
    ).where("code is not null")
    catalog, related = table_of(spark, path, r"(?:^|/)Part\.csv$"), table_of(spark, path, r"PartRelatedCodeMapping\.csv$")
    ontology, imaging, main = table_of(spark, path, r"DocumentOntology\.csv$"), table_of(spark, path, r"ImagingDocument(?:s|Codes)\.csv$"), table_of(spark, path, r"(?:^|/)Loinc\.csv$")
    uses = rows.where("number is not null and name is not null")
    doc_rows = None
    if ontology is not None:
        o = columns(ontology)
        doc_rows = ontology.select(o("LoincNumber").alias("code"), o("PartNumber").alias("number"), _typed(o("PartTypeName")).alias("type"), o("PartName").alias("name"), o("PartSequenceOrder").alias("order")).where("code is not null")
    every = uses.select("number", "type", "name", "rid", "rid_name")
    if doc_rows is not None:
        nothing = F.lit(None).cast("string")
        every = every.unionByName(doc_rows.where("number is not null").select("number", "type", "name", nothing.alias("rid"), nothing.alias("rid_name")))
    parts = cut(parts_of(every, catalog, related, source))
    maps = F.concat(
        F.array(mapping(F.lit(source), F.col("code"), F.col("n"))), F.transform("rids", lambda x: mapping(F.lit(RADLEX), x["rid"], x["rid_name"], "AUTHORITATIVE_PLAYBOOK")),
        F.transform("rpids", lambda x: mapping(F.lit(RADLEX), x["rpid"], x["rpid_name"], "AUTHORITATIVE_PLAYBOOK_PROCEDURE")),
    )
    some = lambda a, c: F.sort_array(F.collect_set(F.when(F.col(a).isNotNull(), F.struct(a, c))))
    seen = rows.groupBy("code").agg(F.min("long_name").alias("long_name"), some("rid", "rid_name").alias("rids"), some("rpid", "rpid_name").alias("rpids")).withColumn("n", F.coalesce("long_name", "code"))
    seen = seen.join(_composed(uses, parts, source), "code", "left")
    out = seen.select(*concept("LOINC_PROC", [F.col("code"), F.col("n")], F.col("n"), F.lit("IMAGING_PROCEDURE"), source, maps, relationships=F.col("relationships"), attributes=F.create_map(F.lit("record_type"), F.lit("RADIOLOGY_PROCEDURE"))))
    out = out.unionByName(parts.drop("number"))
    docs = documents_of(doc_rows, imaging, main, parts, source)
    return out if docs is None else out.unionByName(docs)


def documents_of(ontology: DataFrame | None, imaging: DataFrame | None, main: DataFrame | None, parts: DataFrame, source: str) -> DataFrame | None:
    """Concepts of documents: those of the ontology and the imaging documents together by code; an imaging document's own name and kind hold, what it is made of comes from the ontology."""
    spark, nothing = parts.sparkSession, "code string, {} string"
    names = spark.createDataFrame([], nothing.format("m_name"))
    if main is not None:
        m = columns(main)
        names = main.select(m("LOINC_NUM", "LoincNumber").alias("code"), m("LONG_COMMON_NAME", "LongCommonName").alias("m_name")).where("code is not null and m_name is not null").dropDuplicates(["code"])
    pictured = spark.createDataFrame([], nothing.format("i_name"))
    if imaging is not None:
        i = columns(imaging)
        pictured = imaging.select(i("LOINC_NUM", "LoincNumber", "LOINC").alias("code"), i("LONG_COMMON_NAME", "LongCommonName", "DocumentTypeName", "Term").alias("i_name")).where("code is not null and i_name is not null").dropDuplicates(["code"])
    if ontology is None and imaging is None:
        return None
    known = spark.createDataFrame([], f"code string, relationships array<{RELATIONSHIP}>")
    if ontology is not None:
        known = ontology.select("code").distinct().join(_composed(ontology.where("number is not null"), parts, source), "code", "left")
    both = known.withColumn("in_ontology", F.lit(True)).join(pictured, "code", "full_outer").join(names, "code", "left")
    name = F.coalesce("i_name", "m_name", "code")
    kind = F.when(F.col("i_name").isNotNull(), "IMAGING_DOCUMENT").otherwise("DOCUMENT_ONTOLOGY")
    return both.select(*concept("LOINC_DOC", [F.col("code"), name], name, F.lit("DOCUMENT_REPORT"), source, F.array(mapping(F.lit(source), F.col("code"), name)), relationships=F.col("relationships"), attributes=F.create_map(F.lit("record_type"), kind)))


def loinc_codes(spark: SparkSession, path: str, source: str = "LOINC") -> DataFrame:
    """Concepts of the main table of laboratory and clinical codes (CSV with a header)."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    c = columns(df)
    name = F.coalesce(c("LONG_COMMON_NAME", "LongCommonName"), c("COMPONENT"))
    code = c("LOINC_NUM", "LoincNumber")
    return df.where(code.isNotNull() & name.isNotNull()).select(*concept("LOINC", [code, name], name, F.lit("LABORATORY_TEST"), source, F.array(mapping(F.lit(source), code, name)), F.transform(F.split(F.coalesce(c("RELATEDNAMES2"), F.lit("")), ";"), lambda x: F.trim(x))))


def _family(text: Column, ladder: Sequence[tuple[str, str]], other: str) -> Column:
    low, out = F.lower(text), None
    for word, family in ladder:
        hit = low.rlike(word)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise(other)


# Words that decide the family of a lexicon's class, and of a context group, the first that fits.
CLASS_FAMILIES = [
    ("anatom", "BODY_REGION"), ("report component", "REPORT_COMPONENT"), ("report", "DOCUMENT_REPORT"), ("observation", "IMAGING_OBSERVATION"), ("finding", "CLINICAL_FINDING"), ("procedure", "IMAGING_PROCEDURE"),
    ("property", "PROPERTY"), ("temporal", "TEMPORAL_ENTITY"), ("modality", "IMAGING_MODALITY"),
]
GROUP_FAMILIES = [
    ("report heading|report element|report section", "REPORT_COMPONENT"), ("report|document title", "DOCUMENT_REPORT"), ("anatom", "BODY_REGION"), ("modalit", "IMAGING_MODALITY"), ("contrast|agent", "CONTRAST"),
    ("finding", "IMAGING_OBSERVATION"), ("procedure", "IMAGING_PROCEDURE"), ("measurement", "PROPERTY"),
]
# Context groups that matter to radiology, and attributes of images that do.
CONTEXT_GROUPS = "2 4 12 13 29 33 62 63 100 101 102 108 109 1001 1002 1003 1004 1005 1006 3850 4009 4013 4030 4031 4050 6052 6053 6101 6109 7000 7001 7002 7021 7035 7260 8134 9233 10013 10014 12024 12100 12245 12320".split()
ATTRIBUTES = (
    "Modality|ModalitiesInStudy|BodyPartExamined|AnatomicRegionSequence|ProtocolName|SeriesDescription|ContrastBolus.*|ScanningSequence|SequenceVariant|ScanOptions|MRAcquisitionType|SliceThickness|RepetitionTime|EchoTime"
    "|InversionTime|MagneticFieldStrength|AcquisitionContrast|ImageType|PerformedProcedureStepDescription|RequestedProcedureDescription|StudyDescription"
)


def radlex(spark: SparkSession, path: str, source: str = RADLEX) -> DataFrame:
    """Concepts of a radiology lexicon: a CSV of classes and the ontology in OWL, from a folder or its archives.

    Obsolete classes are left out, and those whose id the ontology doesn't hold. The family of a class comes from its label,
    its semantic types and the labels of all its ancestors; parents become IS_A relationships.
    """
    df, owl = table_of(spark, path, r"Radlex\.csv$"), members(spark, path, r"RadLex[^/]*\.owl$|\.rdf$")
    if df is None or not owl:
        raise ValueError("a lexicon needs its CSV and its ontology")
    c = columns(df)
    last = lambda x: F.element_at(F.split(F.trim(x), "/"), -1)
    several = lambda x: F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[|;]"), lambda y: F.trim(y)), lambda y: y != "")
    rows = df.select(
        last(c("Class ID", "RadLexID")).alias("rid"), c("Preferred Label", "Preferred_name").alias("label"), several(c("Synonyms", "Synonym")).alias("synonyms"), F.transform(several(c("Parents")), last).alias("parents"),
        F.coalesce(c("Semantic Types"), F.lit("")).alias("semantic"), c("Definitions", "Definition").alias("definition"), F.coalesce(F.lower(c("Obsolete")), F.lit("")).alias("obsolete"),
    ).where("rid is not null and label is not null and obsolete not in ('true', '1', 'yes')")
    rows = cut(rows.drop("obsolete").dropDuplicates(["rid"]))
    labels = rows.select(F.col("rid").alias("ancestor"), F.col("label").alias("a_label"))
    edges = rows.select(F.col("rid").alias("child"), F.explode("parents").alias("parent"))
    above = ancestors(edges).join(labels, "ancestor").groupBy(F.col("child").alias("rid")).agg(F.array_join(F.sort_array(F.collect_set("a_label")), " ").alias("above"))
    identity = lambda label, semantic: F.concat(F.lit("RADLEX_"), F.upper(F.substring(F.sha2(F.array_join(F.filter(F.array(term_key(label), term_key(semantic)), lambda x: x != ""), "|"), 256), 1, 16)))
    ids = rows.select(F.col("rid").alias("parent"), identity(F.col("label"), F.col("semantic")).alias("p_id"))
    target = F.coalesce("p_id", F.concat(F.lit("RADLEX_EXTERNAL_"), F.upper(F.substring(F.sha2(term_key(F.col("parent")), 256), 1, 16))))
    up = edges.join(ids, "parent", "left").groupBy(F.col("child").alias("rid")).agg(F.sort_array(F.collect_set(relationship("IS_A", target, source, F.lit("rdfs:subClassOf"), F.lit(None).cast("string"), F.col("parent")))).alias("up"))
    named = spark.read.text(owl).select(F.explode(F.regexp_extract_all("value", F.lit(r"(RID\d+)"), F.lit(1))).alias("rid")).distinct()
    whole = rows.join(named, "rid", "left_semi").join(above, "rid", "left").join(up, "rid", "left")
    family = _family(F.concat_ws(" ", "label", "semantic", "above"), CLASS_FAMILIES, "DOMAIN_SIGNAL")
    attributes = F.create_map(F.lit("record_type"), F.lit("RADLEX_ONTOLOGY"), F.lit("semantic_types"), F.col("semantic"), F.lit("definition"), F.coalesce("definition", F.lit("")))
    return whole.select(*concept("RADLEX", [F.col("label"), F.col("semantic")], F.col("label"), family, source, F.array(mapping(F.lit(source), F.col("rid"), F.col("label"))), F.col("synonyms"), F.col("up"), attributes))


def rf2(spark: SparkSession, path: str, subset: DataFrame, source: str = SNOMED) -> DataFrame:
    """Concepts of the description files in release format 2 (tab-separated): active rows of the concepts in ``subset`` (``concept_id``) that have a full name."""
    df = spark.read.csv(members(spark, path, r"sct2_Description_.*\.txt$") or path, header=True, sep="\t", quote="").where("active = '1'").join(subset.select(F.trim(F.col("concept_id").cast("string")).alias("conceptId")).distinct(), "conceptId", "left_semi")
    full = F.col("typeId") == "900000000000003001"
    made = df.groupBy("conceptId").agg(F.min(F.when(full, F.col("term"))).alias("name"), F.array_sort(F.collect_set(F.when(~full, F.col("term")))).alias("synonyms")).where("name is not null")
    name = F.col("name")
    return made.select(*concept("SNOMED", [name], name, F.lit("DOMAIN_SIGNAL"), source, F.array(mapping(F.lit(source), F.col("conceptId"), name)), F.col("synonyms"), attributes=F.create_map(F.lit("active"), F.lit("1"))))


CELLS = "array<struct<para:string>>"


def _cell(cells: Column, i: int) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.get(cells, F.lit(i))["para"], "\u200b", ""), r"\s+", " "))


def dicom_attributes(spark: SparkSession, path: str, keywords: str = ATTRIBUTES, source: str = "DICOM") -> DataFrame:
    """Attributes of a data dictionary in DocBook, rows of tag, name, keyword, representation and multiplicity, of the keywords that match."""
    rows = spark.read.format("xml").option("rowTag", "tr").schema(f"td {CELLS}").load(path)
    made = rows.select(*[_cell(F.col("td"), i).alias(c) for i, c in enumerate(("code", "name", "keyword", "vr", "vm"))]).withColumn("keyword", F.regexp_replace("keyword", "[^A-Za-z0-9]", ""))
    made = made.where(F.col("vm").isNotNull() & F.col("keyword").rlike(f"^(?:{keywords})$"))
    family = F.when(F.col("keyword").isin("BodyPartExamined", "AnatomicRegionSequence"), "BODY_REGION").otherwise("ACQUISITION")
    attributes = F.create_map(F.lit("record_type"), F.lit("PS3.6"), F.lit("keyword"), F.col("keyword"), F.lit("vr"), F.col("vr"), F.lit("vm"), F.col("vm"))
    return made.select(*concept("DICOM", [F.col("keyword")], F.col("name"), family, source, F.array(mapping(F.lit(source), F.col("code"), F.col("name"))), F.array("keyword"), attributes=attributes))


def context_groups(spark: SparkSession, path: str, source: str = "DICOM_DCMR", groups: Sequence[str] = tuple(CONTEXT_GROUPS)) -> DataFrame:
    """Context groups of a content mapping resource in DocBook, and their coded members, each a MEMBER_OF its group."""
    schema = f"`_xml:id` string, _id string, title string, table array<struct<tbody:struct<tr:array<struct<td:{CELLS}>>>>>"
    s = spark.read.format("xml").option("rowTag", "section").schema(schema).load(path)
    s = s.withColumn("cid", F.regexp_extract(F.coalesce("`_xml:id`", "_id", F.lit("")), r"(?i)^sect_CID_(\d+)$", 1)).where(F.col("cid").isin(*groups))
    s = s.withColumn("title", F.coalesce(F.nullif(F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit("")), F.concat(F.lit("DICOM CID "), F.col("cid"))))
    family = _family(F.col("title"), GROUP_FAMILIES, "IMAGING_TECHNIQUE")
    record = lambda kind, *more: F.create_map(F.lit("record_type"), F.lit(kind), F.lit("cid"), F.col("cid"), *more)
    of = concept("DCMR_CID", [F.col("cid"), F.col("title")], F.col("title"), family, source, F.array(mapping(F.lit(source), F.concat(F.lit("CID:"), F.col("cid")), F.col("title"))), attributes=record("DCMR_CONTEXT_GROUP"))
    rows = s.select("cid", "title", of[0].alias("group_id"), F.explode("table").alias("t")).select("cid", "title", "group_id", F.explode("t.tbody.tr").alias("r"))
    rows = rows.select("cid", "title", "group_id", *[_cell(F.col("r.td"), i).alias(c) for i, c in enumerate(("scheme", "code", "meaning"))]).where("code != '' and meaning != '' and scheme not like '%Coding Scheme%'")
    to = F.when(F.col("scheme").isin("SCT", "SRT"), SNOMED).when(F.col("scheme") == "LN", "LOINC_RSNA").otherwise(source)
    maps = F.array(mapping(to, F.col("code"), F.col("meaning"), "DCMR_MEMBER"), mapping(F.lit(source), F.concat_ws(":", F.lit("CID"), "cid", "scheme", "code"), F.col("meaning"), "DCMR_MEMBERSHIP"))
    member = F.array(relationship("MEMBER_OF", F.col("group_id"), source, F.lit("DCMR_CONTEXT_GROUP"), F.lit(None).cast("string"), F.concat(F.lit("CID:"), F.col("cid"))))
    coded = rows.select(*concept("DCMR", [F.col("cid"), F.col("scheme"), F.col("code"), F.col("meaning")], F.col("meaning"), family, source, maps, relationships=member, attributes=record("DCMR_CODE", F.lit("coding_scheme"), F.col("scheme"))))
    return s.select(*of).unionByName(coded)


#: Importers by the family of their source; each takes (spark, path, **options). ``register`` adds others.
IMPORTERS: dict[str, Callable[..., DataFrame]] = {"LOINC_RSNA_PLAYBOOK": loinc, "DICOM": dicom_attributes, "DICOM_DCMR": context_groups, "RADLEX": radlex, "SNOMED_CT": rf2}


def register(family: str, importer: Callable[..., DataFrame], replace: bool = False) -> None:
    if family in IMPORTERS and not replace:
        raise ValueError(f"{family} has an importer")
    IMPORTERS[family] = importer


def imported(spark: SparkSession, family: str, path: str, **options: object) -> DataFrame:
    """The concepts of an artifact by the importer of its family."""
    if family not in IMPORTERS:
        raise ValueError(f"no importer for {family}")
    return IMPORTERS[family](spark, path, **options)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a manifest in JSON, one row each."""
    return spark.read.option("multiLine", "true").json(path).select(F.inline("sources"))


def status(sources: DataFrame, active: DataFrame, kept: DataFrame, curated: str = "") -> DataFrame:
    """(source_id, expected_version, status, active_version, concepts, mappings): each source of a manifest with its active version and what was imported for it.

    ``active`` has source_id and version, ``kept`` source_id, version, concept_count and mapping_count.
    """
    j = sources.select("source_id", F.col("version").alias("expected_version"), "distribution_policy").join(active.select("source_id", F.col("version").alias("active_version")), "source_id", "left")
    j = j.join(kept.select("source_id", F.col("version").alias("active_version"), "concept_count", "mapping_count"), ["source_id", "active_version"], "left")
    own = F.col("source_id") == curated
    state = F.when(F.col("active_version").isNotNull() | own, "ACTIVE").when(F.col("distribution_policy") == "LICENSE_RESTRICTED", "LICENSED ARTIFACT REQUIRED").otherwise("MISSING ARTIFACT")
    return j.select("source_id", "expected_version", state.alias("status"), F.coalesce("active_version", F.when(own, F.col("expected_version"))).alias("active_version"), F.coalesce("concept_count", F.lit(0)).alias("concepts"), F.coalesce("mapping_count", F.lit(0)).alias("mappings"))


def import_metrics(concepts: DataFrame) -> DataFrame:
    """(concept_count, mapping_count) of what was imported: the figures of a receipt."""
    return concepts.agg(F.count("*").alias("concept_count"), F.coalesce(F.sum(F.size("mappings")), F.lit(0)).alias("mapping_count"))


def activated(active: DataFrame, kept: DataFrame, source: str, version: str) -> DataFrame:
    """``active`` (source_id, version) with one source at another version, which must have a receipt in ``kept``."""
    if kept.where((F.col("source_id") == source) & (F.col("version") == version)).isEmpty():
        raise ValueError(f"no import of {source} {version}")
    return active.where(F.col("source_id") != source).unionByName(active.sparkSession.createDataFrame([(source, version)], "source_id string, version string"))


def snapshot(active: DataFrame) -> DataFrame:
    """One row with the active versions of all sources as JSON."""
    return active.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_id", "version"))))).alias("configuration"))  # one entry a source


def directory_digest(kept: DataFrame, root: str) -> DataFrame:
    """(sha256) of a folder's files: the digest of their sorted relative paths and digests. A file tree's listing is one row's array."""
    rel = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(root.removeprefix("file:").strip("/")) + "/*", "")
    return kept.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rel.alias("p"), "sha256"))), lambda x: F.concat(x["p"], F.lit(" "), x["sha256"])), "\n"), 256).alias("sha256"))


def store(concepts: DataFrame, root: str, source: str, version: str) -> None:
    """Write one version of a source; a version is replaced as a whole."""
    concepts.write.mode("overwrite").parquet(f"{root}/source_id={source}/version={version}")


def load(spark: SparkSession, root: str, active: DataFrame | None = None) -> DataFrame:
    """All stored concepts, or those of the versions in ``active`` (``source_id``, ``version``)."""
    df = spark.read.option("basePath", root).parquet(f"{root}/source_id=*/version=*").withColumn("version", F.col("version").cast("string"))
    return df if active is None else df.join(active.select("source_id", "version").distinct(), ["source_id", "version"], "left_semi")


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of each file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def unverified(kept: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose checksum differs from the receipt, or that are missing."""
    return kept.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "left").where(~F.col("was").eqNullSafe(F.col("is")))
