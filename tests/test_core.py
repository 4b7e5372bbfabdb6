import glob
import io
import math
import os
import random
import re
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardloom.functions import scalars
from wardloom.operators import candidates, concepts, spans, terms
from wardloom.plans import protect, queries, understand
from wardloom.sources import files, terminology
from wardloom.streaming import documents as stream


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    one = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(queries.SQL[name]).df())


def test_spans_equal_those_of_a_regex_library(spark):
    texts = ["", "a@b.co and c.d@e.org!", "Phone: +965 1234 5678\nTel 12345678", "x" * 100_000 + " me@here.net", "😀 x@y.zz 😀 MRN: AB-12", "رقم الملف ٢١٥ Civil ID 123456789012", None]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, value string")
    for rule in [protect.EMAIL_RULE, protect.PHONE_RULE, *protect.FIELD_RULES]:
        _, _, _, pattern, _, value = rule
        want = {(i, m.start(value), m.end(value), m.group(value)) for i, t in enumerate(texts) if t for m in re.finditer(pattern, t)}
        got = {tuple(r) for r in spans.extracted(df, ["id"], "text", [rule]).select("id", "start_pos", "end_pos", "value").collect()}
        assert got == want, rule[0]


def test_transformed_values(spark):
    df = spark.createDataFrame([("abcd", "mrn"), ("abcdef", "mrn"), (None, "mrn")], "v string, k string")
    got = df.select(*[scalars.transformed(F.col("v"), F.col("k"), F.lit(a)).alias(a) for a in ("keep", "replace", "hash", "mask", "remove")]).collect()
    assert got[0].mask == "****" and got[1].mask == "ab**ef" and got[1].replace == "[MRN]" and got[1].remove == "[REMOVED]" and got[1].keep == "abcdef"
    assert re.fullmatch(r"\[MRN:[0-9a-f]{10}\]", got[1].hash) and got[2].mask is None


def test_deidentified_rewrites_accepted_spans_only(spark):
    text = "Patient Name: Ann Bell\nEmail: a@b.com\nCivil ID: 123456789012\nPhone: +96512345678"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing here"), (1, text)], "id int, text string")
    got = {r.id: r for r in protect.deidentified(df, ["id"], "clinical").collect()}
    assert len(got) == 4
    assert got[1].protected.startswith("Patient Name: [PATIENT_NAME]\nEmail: [EMAIL]\nCivil ID: [CIVIL_ID:") and got[1].protected.endswith("Phone: [PHONE_NUMBER]")
    assert got[2].protected is None and got[3].protected == "" and got[4].protected == "nothing here"
    strict = {r.id: r.protected for r in protect.deidentified(df, ["id"], "strict_privacy").collect()}
    assert strict[1].count("[REMOVED]") == 4
    with pytest.raises(ValueError):
        protect.deidentified(df, ["id"], "none such")


def test_deidentified_finds_names_by_the_label_of_their_line(spark):
    text = "Reporting Physician: Dr. Omar Vale\nConsultant Pathologist: Dr Ann Bell\nطبيب الأشعة: د. سالم\nPatient: Eve Moor\nMRN: AB-1234\nnote on Dr. Grey"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = {p: protect.deidentified(df, ["id"], p).first().protected for p in protect.PROFILES}
    assert got["strict_privacy"] == "Reporting Physician: Dr. [REMOVED]\nConsultant Pathologist: Dr [REMOVED]\nطبيب الأشعة: د. [REMOVED]\nPatient: [REMOVED]\nMRN: [REMOVED]\nnote on Dr. Grey"
    for p in ("research", "analytics_public_health"):
        assert "Omar" not in got[p] and "Bell" not in got[p] and "سالم" not in got[p] and "Patient: [PATIENT_NAME]" in got[p]
    assert "Dr. Omar Vale" in got["clinical"] and "Patient: [PATIENT_NAME]" in got["clinical"]
    found = protect.detected(df, ["id"]).where("kind = 'physician_name'").collect()
    assert {r.value for r in found} == {"Omar Vale", "Ann Bell", "سالم"}


def test_detected_finds_names_after_every_label_of_clinicians(spark):
    text = "Attending Physician: Dr. Omar Vale\r\nAuthorized by:\n Dr. Ann Bell \nReported By: Ina Moor\nالطبيب المعالج: د. سالم\nاستشاري علم الأمراض : د جابر\nDoctor: Dr. Lee = x\nphysician: dr. Roe"
    found = protect.detected(spark.createDataFrame([(1, text)], "id int, text string"), ["id"])
    got = {(r.start_pos, r.value) for r in found.where("kind = 'physician_name'").collect()}
    assert got == {(text.index(v), v) for v in ("Dr. Omar Vale", "Dr. Ann Bell", "سالم", "جابر", "dr. Roe")}  # a value with an equals sign is none


def test_greedy_keeps_the_first_of_overlapping_spans(spark):
    df = spark.sql("SELECT array(named_struct('start_pos', 5, 'end_pos', 9), named_struct('start_pos', 0, 'end_pos', 6), named_struct('start_pos', 0, 'end_pos', 5)) AS s")
    assert [(x.start_pos, x.end_pos) for x in df.select(spans.greedy(F.col("s")).alias("s")).first().s] == [(0, 5), (5, 9)]


def test_sections_end_where_the_next_begins(spark):
    df = spark.createDataFrame([(1, "Findings:\nall well\nIMPRESSION\ndone"), (2, None), (3, "")], "doc_id int, text string")
    names = spark.createDataFrame([("findings", "Findings"), ("impression", "Impression"), ("x", None)], "canonical_name string, alias string")
    got = [tuple(r) for r in understand.line_sections(df, names).orderBy("start_pos").collect()]
    assert got == [(1, "findings", "Findings", 0, 19), (1, "impression", "IMPRESSION", 19, 34)]


def test_line_counts(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\n\nb\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalars.line_count(F.col("t"))).collect()] == [len(t.splitlines()) if t is not None else None for t in texts]


def test_ancestors_end_at_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "d")], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in concepts.ancestors(e).collect()}
    assert got[("d", "a")] == 1 and got[("d", "c")] == 3 and ("a", "a") not in got and len(got) == 9


def test_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k int, v string")
    assert {(r.k, r.change) for r in concepts.differences(a, b, "k", "v").collect()} == {(2, "changed"), (3, "removed"), (4, "added")}


def _docx(paragraphs: list[str]) -> bytes:
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def test_files(spark, tmp_path):
    for name, content in {"a.txt": "é\nb".encode(), "b.TXT": "é".encode("cp1252"), "c.docx": _docx(["one", "two"]), "d.docx": b"broken", "e.bin": b"x", "noext": b"x", "f.txt": b""}.items():
        (tmp_path / name).write_bytes(content)
    df = files.documents(spark, str(tmp_path))
    got = {r.file_name: r for r in files.contract(df).collect()}
    assert got["a.txt"].text == "é\nb" and got["a.txt"].line_count == 2 and got["b.TXT"].encoding == "cp1252" and got["b.TXT"].text == "é"
    assert got["c.docx"].text == "one\n\ntwo\n\nc1\tc2\n\ntop"
    assert all(got[n].error for n in ("d.docx", "e.bin", "noext")) and "f.txt" not in got
    good, bad = files.quarantined(df)
    assert good.count() == 3 and bad.count() == 3


def test_extractors():
    e = files.Extractors()
    assert ".PDF" in e and "xyz" not in e
    e.register("md", lambda content: (content.decode(), "utf-8", 1, {}, []))
    assert e.counts() == (4, 4) and e.extensions() == [".docx", ".md", ".pdf", ".txt"]
    with pytest.raises(TypeError):
        e.register("rtf", "txt")
    with pytest.raises(ValueError):
        e.register(".md", print)
    with pytest.raises(ValueError):
        e.get("a.b")
    e.unregister("md")
    assert "md" not in e


def test_terminologies(spark, tmp_path):
    (tmp_path / "l.csv").write_text('LOINC_NUM,LONG_COMMON_NAME,RELATEDNAMES2\n1-1,Chest X-ray,"CXR; chest film"\n2-2,,\n')
    c = terminology.loinc_codes(spark, str(tmp_path / "l.csv"))
    got = c.collect()
    assert len(got) == 1 and got[0].synonyms == ["CXR", "chest film"] and got[0].mappings[0].external_id == "1-1"
    terminology.store(c, str(tmp_path / "s"), "loinc", "4")
    kept = terminology.load(spark, str(tmp_path / "s"), spark.createDataFrame([("loinc", "4")], "source_id string, version string"))
    assert kept.count() == 1 and tuple(terminology.import_metrics(kept).first()) == (1, 1)
    for bad in (lambda: terminology.imported(spark, "NONE", str(tmp_path)), lambda: terminology.loinc(spark, str(tmp_path)), lambda: terminology.radlex(spark, str(tmp_path)), lambda: terminology.register("DICOM", print)):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "d.txt").write_text("conceptId\tactive\ttypeId\tterm\n1\t1\t900000000000003001\tLung (body)\n1\t1\t5\tLung\n2\t1\t5\tArm\n1\t0\t5\tOld\n")
    got = terminology.rf2(spark, str(tmp_path / "d.txt"), spark.createDataFrame([("1",)], "concept_id string")).collect()
    assert len(got) == 1 and got[0].canonical_name == "Lung (body)" and got[0].synonyms == ["Lung"]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "Email: a@b.com"), (2, None)], "request_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    src = stream.arriving(spark, str(tmp_path / "in"), "request_id long, text string")
    stream.written(stream.protected(src, "clinical"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = {r.request_id: r.protected for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "Email: [EMAIL]", 2: None}


def test_policy_covers_every_type_once():
    assert len(protect.policy_rows()) == len({(p, t) for p, t, _ in protect.policy_rows()})


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert protect.deidentified(df, ["doc_id"], "research").count() == 0
    assert understand.classified(df).count() == 0
    assert understand.contexts(df).count() == 0
    assert concepts.resolved(df, spark.createDataFrame([], "concept_id string, term string")).count() == 0


def test_terms_are_given_back(spark):
    df = spark.createDataFrame([(1, "A Cyst, a pain  score; cystic."), (2, ""), (3, None)], "doc_id int, text string")
    p = df.select("doc_id", "text", terms.protected(F.col("text"), ["cyst", "pain score", "pain"]).alias("p"))
    got = {r.doc_id: (r.p.text, r.back) for r in p.withColumn("back", terms.restored(F.col("p.text"), F.col("p.tokens"))).collect()}
    assert got[1] == ("A __CTX_0001__, a __CTX_0002__; cystic.", "A Cyst, a pain  score; cystic.") and got[2] == ("", "") and got[3] == (None, None)


def test_nearest_spans(spark):
    a = spark.createDataFrame([(1, 10, 14, "liver"), (1, 500, 505, "lung")], "doc_id int, start_pos int, end_pos int, label string")
    b = spark.createDataFrame([(1, 0, 4, "CT"), (1, 16, 18, "MRI"), (2, 10, 12, "XR")], "doc_id int, start_pos int, end_pos int, label string")
    assert [(r.label, r.near, r.gap) for r in terms.nearest(a, b, "doc_id").collect()] == [("liver", "MRI", 2)]


def test_streams_give_what_batches_give(spark, tmp_path):
    texts = ["Patient: Ann Bell\r\nMRN: AB-1234", "Consultant: Dr. Sam Roe\nRADIOLOGY REPORT\nFindings: CT\nImpression: x", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    src = stream.arriving(spark, str(tmp_path / "in"), "request_id long, text string")
    stream.written(stream.understood(stream.protected(src, "research")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r.request_id: (r.protected, r.safe, r.classification and r.classification.document_type) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    kinds = {r.request_id: r.document_type for r in understand.classified(df, "request_id").collect()}
    want = {r.request_id: (r.protected, r.safe, kinds.get(r.request_id)) for r in protect.deidentified(df, ["request_id"], "research").collect()}
    assert got == want and got[0][0].startswith("Patient: [PATIENT_NAME]\r\n")


def test_nothing_is_shuffled_to_deidentify_or_classify(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for made in (protect.deidentified(df, ["doc_id"], "clinical"), understand.classified(df)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_a_reader_without_its_library_is_a_row_with_an_error(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 broken")
    assert files.documents(spark, str(tmp_path)).first().error


def test_merging_is_that_of_a_loop(spark):
    """Overlaps settled by the fold, against the same rule written as a loop over random candidates."""
    r = random.Random(3)
    kinds, sources = ["mrn", "person_name", "email", "exam_date", "unknown"], list(candidates.SOURCE_PRIORITY)
    sets = [[(i, r.choice(sources), r.choice(kinds), s := r.randint(0, 30), s + r.randint(1, 8), r.choice([None, 0.9, 0.91, 0.97, 1.0]), r.choice(["accept", "reject", "review_required"])) for i in range(r.randint(0, 12))] for _ in range(60)]

    def score(c: tuple) -> int:
        return candidates.SOURCE_PRIORITY[c[1]] + candidates.DECISION_PRIORITY[c[6]] + candidates.TYPE_PRIORITY.get(c[2], 0) + (0 if c[5] is None else int(c[5] * 10))

    def loop(found: list[tuple]) -> list[int]:
        kept: list[tuple] = []
        for c in sorted(found, key=lambda c: (-score(c), c[3] - c[4], c[3], c[0])):
            over = [k for k in kept if c[3] < k[4] and c[4] > k[3]]
            if over:
                top = max(over, key=score)
                if score(top) != score(c) or top[4] - top[3] != c[4] - c[3] or c[5] is None or top[5] is not None and c[5] <= top[5]:
                    continue
                kept = [k for k in kept if k not in over]
            kept.append(c)
        return [c[0] for c in sorted(kept, key=lambda c: (c[3], c[4]))]

    flat = [(n, *c) for n, found in enumerate(sets) for c in found]
    df = spark.createDataFrame(flat, "id int, seq int, source string, kind string, s int, e int, c double, d string")
    x = candidates.struct(seq=F.col("seq"), source=F.col("source"), kind=F.col("kind"), start_pos=F.col("s"), end_pos=F.col("e"), value=F.lit("v"), confidence=F.col("c"), decision=F.col("d"))
    got = {g.id: g.k for g in df.groupBy("id").agg(F.array_sort(F.collect_list(x)).alias("f")).select("id", F.transform(candidates.settled(F.col("f")), lambda y: y["seq"]).alias("k")).collect()}
    assert got == {n: loop(found) for n, found in enumerate(sets) if found}
