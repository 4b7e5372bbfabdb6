import math
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardloom.llm import encodings, languages, leakage, lookalike, mapping, packing, personal, queries, sentences, spans

# -- spans (problem 9)


def brute_ranges(docs: dict[int, str], span: int) -> set[tuple[int, int, int]]:
    out = set()
    for i, t in docs.items():
        others = {u[s : s + span] for j, u in docs.items() if j != i for s in range(len(u) - span + 1)}
        hit = [s for s in range(len(t) - span + 1) if t[s : s + span] in others]
        merged: list[list[int]] = []
        for s in hit:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = s + span
            else:
                merged.append([s, s + span])
        out |= {(i, a, b) for a, b in merged}
    return out


def test_shared_ranges_equal_brute_force(spark):
    r = random.Random(4)
    parts = ["".join(r.choices("abcd é😀", k=r.randint(5, 60))) for _ in range(12)]
    docs = {i: "".join(r.choices(parts, k=r.randint(0, 6))) + "".join(r.choices("xyz", k=r.randint(0, 30))) for i in range(25)}
    docs |= {100: "a" * 400, 101: "b" + "a" * 90, 102: docs[3], 103: ""}
    rows = [(i, t, "clash") for i, t in docs.items()] + [(3, docs[3], "again"), (None, docs[3], None), (200, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, d string")
    got = {tuple(x) for x in spans.shared_ranges(df, span=20).collect()}
    assert got == brute_ranges(docs, 20)
    report = {x.doc_id: x.shared_chars for x in spans.shared_report(df, span=20).collect()}
    assert all(report[i] == sum(b - a for j, a, b in got if j == i) for i in docs)


# -- leaks (problem 8)


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "straße", "x1", "日本"]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 9)))) for i in range(12)] + [(50, None), (51, "?!"), (None, "alpha")]
    docs = [(i, r.choice([", ", " ", "\n"]).join(r.choices(words, k=r.randint(0, 14)))) for i in range(30)] + [(90, None), (91, "")]

    def leaked(t: str, i: str) -> bool:
        a, b = leakage.words(t), leakage.words(i)
        n = math.ceil(len(b) / 2)
        runs = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
        return any(tuple(a[k : k + n]) in runs for k in range(len(a) - n + 1))

    want = {(d, i) for d, t in docs if t for i, x in items if x and i is not None and leaked(t, x)}
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    for block in (1000, 4):
        assert {tuple(x) for x in leakage.leaked_items(d, i, block_items=block).collect()} == want


# -- packing (problem 7)


def test_packs_hold_every_token_once(spark):
    rows = [(i, "word " * (i * 37 % 900), "clash") for i in range(60)] + [(99, "long text " * 3000, ""), (100, None, ""), (101, "", "")]
    df = spark.createDataFrame(rows, "doc_id int, text string, piece string")
    size = {x.doc_id: x.tokens for x in packing.sizes(df).collect()}
    got = packing.packed(df, group=25).collect()
    by: dict[int, list] = {}
    for x in got:
        by.setdefault(x.pack_id, []).append(x)
        assert x.pack_tokens <= 2048 and x.pack_segments <= 64
    for d, n in size.items():
        own = sorted((x.first_token, x.last_token) for x in got if x.doc_id == d)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:])) and (len(own) == 1 or n > 2048)
    assert all(sum(x.tokens for x in p) == p[0].pack_tokens for p in by.values())
    assert sum(size.values()) / (2048 * len(by)) > 0.9
    assert not {100, 101} & {x.doc_id for x in got}


def test_packs_keep_every_limit(spark):
    rows = [(i, "head line of a prompt " * (i % 4 * 150) + "\n" + "word " * (i * 53 % 1500)) for i in range(60)] + [(98, "prompt " * 5000 + "\nx"), (99, "long text " * 3000)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    size = {x.doc_id: (x.tokens, x.loss) for x in packing.sizes(df).collect()}
    got = packing.packed(df, max_segments=5, max_loss=900, group=25).collect()
    by: dict[int, list] = {}
    for x in got:
        by.setdefault(x.pack_id, []).append(x)
    assert all(sum(x.tokens for x in p) <= 2048 and sum(x.loss for x in p) <= 900 and len(p) <= 5 for p in by.values())
    for d, (n, loss) in size.items():
        own = sorted((x.first_token, x.last_token, x.loss) for x in got if x.doc_id == d)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] and a[0] < a[1] for a, b in zip(own, own[1:])) and sum(x[2] for x in own) == loss
        assert len(own) == 1 or n > 2048 or loss > 900
    for bad in ({"max_loss": 3000}, {"max_loss": 0}, {"max_segments": 0}):
        with pytest.raises(ValueError):
            packing.packed(df, **bad)


def test_windows_of_very_long_texts_have_the_same_minima(monkeypatch):
    order = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype("uint64")
    order[100:200] = order[300]
    short = spans.sliding_argmin(order, 37)
    monkeypatch.setattr(spans, "PLACE_BITS", 12)
    assert (spans.sliding_argmin(order[:4000], 37) == short[: 4000 - 36]).all() and (spans.sliding_argmin(order, 37) == short).all()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    columns = queries.QUERIES[name](spark, sf_dir)
    got = sorted(tuple(r) for r in columns.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns.columns)} FROM ({queries.SQL[name]})").fetchall())


# -- same look (problem 3)


def test_same_look(spark):
    rows = [
        (1, "Café Peter-Paul"), (2, "Café Peter‑Paul"), (3, "Ｃafé​ Peter-Paul"), (4, "Сafé Peter-Paul"), (5, "café Peter-Paul"), (6, "Cafe Peter-Paul"), (7, "Café\nPeter-Paul"),
        (8, "x²"), (9, "x2"), (10, "1"), (11, "١"), (12, None), (13, ""), (14, "​"), (1, "Café Peter-Paul"), (None, "Café Peter-Paul"), (15, "Café Peter-Paul"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, text string, look string")
    got = {tuple(x) for x in lookalike.same_look_pairs(df, "id").collect()}
    same = [1, 2, 3, 4, 15]
    assert got == {(a, b) for a in same for b in same if a < b and {a, b} != {1, 15}} | {(13, 14)}
    assert unicodedata.normalize("NFC", "é") == "é"


# -- mapping (problem 1)


def test_mapping(spark):
    names = spark.createDataFrame([("findings", "Findings"), ("impression", "Impression"), ("plan", "Plan of Care"), ("plan", None)], "entry string, name string")
    rows = [(1, "FINDINGS:"), (2, "Find1ngs"), (3, "2) Impresion"), (4, "Weather"), (5, None), (6, ""), (7, "plan of care"), (1, "FINDINGS:"), (8, "!!"), (None, "Plan")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, value string, entry string")
    got = {x.id: x.canonical for x in mapping.mapped(df, "id", "value", names).collect()}
    assert got == {1: "findings", 2: "findings", 3: "impression", 4: "UNMATCHED", 5: "UNMATCHED", 6: "UNMATCHED", 7: "plan", 8: "UNMATCHED"}


def test_mapping_in_several_scripts_and_with_words_cut_short(spark):
    listed = [("methods", "الطريقة"), ("history", "شرح حال بالینی"), ("results", "Αποτελέσματα"), ("findings", "Результаты осмотра"), ("impression", "印象診断"), ("allergies", "एलर्जी")]
    many = [(f"e{i}", f"Almon{chr(97 + i)} Register") for i in range(20)]  # more completions of one short word than any small number
    names = spark.createDataFrame([*listed, *many], "entry string, name string")
    rows = [(1, "3) الطريقه:"), (2, "الطريقة"), (3, "ΑΠΟΤΕΛΕΣΜΑΤΑ"), (4, "результаты  осмотра"), (5, "印象診断："), (6, "एलर्जी"), (7, "شرح حال باليني"), (8, "Almont Regis."), (9, "Almon. Register"), (10, "Резул. осмотра"), (11, "غرفة الانتظار")]
    df = spark.createDataFrame(rows, "id int, value string")
    want = {1: "methods", 2: "methods", 3: "results", 4: "findings", 5: "impression", 6: "allergies", 7: "history", 8: "e19", 9: "UNMATCHED", 10: "findings", 11: "UNMATCHED"}
    for block in (1000, 5):
        assert {x.id: x.canonical for x in mapping.mapped(df, "id", "value", names, block_names=block).collect()} == want


def test_mapping_scores_equal_brute_force(spark):
    r = random.Random(8)
    listed = [(f"e{i % 9}", "".join(r.choices("abcdeا日", k=r.randint(1, 12)))) for i in range(40)]
    values = ["".join(r.choices("abcdeا日 ", k=r.randint(0, 14))) for _ in range(60)]
    names = spark.createDataFrame(listed, "entry string, name string")
    forms = {f for _, n in listed for f, _ in mapping.forms_of(n, frozenset())}
    rarity: dict[str, int] = {}
    for f in forms:
        for g in mapping.grams(f):
            rarity[g] = rarity.get(g, 0) + 1

    def vector(f: str) -> dict[str, float]:
        v = {g: math.sqrt(n) * (math.log1p(len(forms) / rarity[g]) if g in rarity else math.log1p(2.0 * len(forms))) for g, n in mapping.grams(f).items()}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {g: w / size for g, w in v.items()}

    got = {x.value: {f.entry: f.score for f in x.found} for x in mapping.scored(spark.createDataFrame([(v,) for v in values], "value string"), names, 0.3).collect()}
    for v in set(values):
        want: dict[str, float] = {}
        for e, n in listed:
            for f, _ in mapping.forms_of(n, frozenset()):
                a, b = vector("".join(v.split())) if v.strip() else {}, vector(f)
                want[e] = max(want.get(e, 0.0), sum(w * b.get(g, 0.0) for g, w in a.items()))
        assert got[v] == pytest.approx({e: s for e, s in want.items() if s >= 0.3})


# -- encodings (problem 4)


def _corpus() -> list[str]:
    r = random.Random(8)
    fr = ["été", "prévenu à", "tolérance", "réduite", "œdème", "léger", "le patient", "reçoit"]
    en = ["the patient’s", "temperature was 38 °C", "a drain of Ø 5 mm", "was left", "near the liver"]
    return [" ".join(r.choices(fr if i % 2 else en, k=9)) + "." for i in range(300)]


@pytest.mark.parametrize("chain", ["utf8>cp1252", "utf8>mac", "utf8>cp1252 twice", "cp1252>cp437"])
def test_damage_is_undone(spark, chain):
    def damage(t: str) -> str:
        for true, read in encodings.CHAINS[chain]:
            t = "".join(next((chr(c) for c, b in encodings.byte_table(read).items() if b == x and chr(c) not in map(chr, range(0x80, 0xA0))), chr(x)) if x >= 0x80 else chr(x) for x in t.encode(true))
        return t

    texts = _corpus()
    bad = {7, 8, 31, 100}
    rows = [("f", i, "s", damage(t) if i in bad else t) for i, t in enumerate(texts)] + [("f", 900, None, None), ("f", 901, "s", ""), ("f", 902, "s", "lost � sign"), ("f", 7, "s", damage(texts[7]))]
    df = spark.createDataFrame(rows, "src string, id int, source string, text string")
    got = {x.id: x for x in encodings.repaired(df, ["src", "id"]).collect()}
    assert {i for i, x in got.items() if x.damaged} == bad | {902}
    for i in bad:
        assert got[i].text == texts[i]
        assert len(got[i].at) == len(texts[i]) + 1 and got[i].at[-1] == len(damage(texts[i]))
    assert got[900].text is None and not got[902].restored


# -- sentences (problem 2)


def test_units(spark):
    base = ["Findings\nSeen by Dr. Smith at 5 p.m. today. It is approx. 3.5 cm.\nShe said ‘It hurts. Really!’ and left. Is it so? asked the family.", "- one. two\n- three\n\nWeight: 5 kg\nThe end\nis here.", "所见\n患者说：「很痛。真的！」并离开。好了！"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(base * 20)] + [(900, None, ""), (901, "", ""), (902, " \n ", ""), (0, base[0], "again")], "id int, text string, k string")
    got: dict[int, list] = {}
    for x in sentences.sentence_units(df, "id").orderBy("id", "start_pos").collect():
        got.setdefault(x.id, []).append(base[x.id % 3][x.start_pos : x.end_pos])
    assert got[1] == ["- one. two", "- three", "Weight: 5 kg", "The end\nis here."]
    assert got[2] == ["所见", "患者说：「很痛。真的！」并离开。", "好了！"]
    assert got[0][0] == "Findings" and got[0][-2:] == ["She said ‘It hurts. Really!’ and left.", "Is it so? asked the family."]
    assert not {900, 901, 902} & set(got)


def test_starters_count_after_rare_words_too(spark):
    word = lambda i: "margol" + "".join(chr(97 + i // 5**k % 5) for k in range(4))
    texts = [f"The patient is {word(i)}. Does it hurt?" for i in range(300)] + ["The pain is of the left side and it does not go."] * 100 + ["Seen by Dr. Weller for the pain of it."] * 100
    s = sentences.learned(spark.createDataFrame([(t,) for t in texts], "text string"))
    starters = set().union(*s.starters.values())
    assert "does" in starters and "weller" not in starters and any("dr" in a for a in s.abbreviations.values())


def test_log_likelihood_is_high_for_what_goes_together():
    assert sentences.log_likelihood(100, 100, 90, 10_000) > 100 > sentences.log_likelihood(100, 100, 1, 10_000)


# -- languages (problem 5)


def test_gradient_is_that_of_finite_differences():
    net = languages.ByteGru(hidden=4, classes=3, seed=1)
    net.p = {k: v.astype("float64") for k, v in net.p.items()}
    x, y = languages.packed_bytes([b"abcd", b"xy"]), np.array([0, 2])

    def loss() -> float:
        p = net.probabilities(x)
        return float(sum(-np.log(p[t, j, y[j]]) for j in range(2) for t in range(4) if x[t, j]) / (x > 0).sum())

    g = net.gradient(x, y)
    for name, where in (("uf", (1, 2)), ("ub", (0, 9)), ("o", (3, 1)), ("xf", (97, 5)), ("xb", (121, 1)), ("c", (2,))):
        old = net.p[name][where]
        net.p[name][where] = old + 1e-4
        up = loss()
        net.p[name][where] = old - 1e-4
        down = loss()
        net.p[name][where] = old
        assert g[name][where] == pytest.approx((up - down) / 2e-4, abs=2e-3), name


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = languages.trained(docs)
    lab = languages.Labeler(net)
    told = languages.pooled(["The patient was seen in the clinic today. The film of the liver was normal.", None, "", "123", "تم فحص العينة من الكلية اليسرى وكان وزنها صغيرا."], lab)
    assert [x for x, _ in told] == ["en", None, None, None, "ar"] and all(0 <= c <= 1 for _, c in told)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert languages.document_languages(empty, net).count() == 0


def test_reduced_texts_and_beginnings_are_those_of_the_plain_rules():
    r = random.Random(9)
    parts = ["84,9", "12/03/2020", "٣٫٥", " ", "  ", "\t", "\n", ",", ":", "：", " : ", ". ", ".", "the Knee", "l’été", "İ", "ß", "(", "…", "患者", "🙂", "𝟓", "a:b", "١٢", "-", "\u200c"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 16))) for _ in range(4000)]
    end = re.compile(r"[\n!?؟。！？।…]+|\.(?=\s|$)")
    for t in texts:
        plain = languages.SIGNS.sub(" ", t)
        assert languages.reduced(t) == plain
        assert languages.sentences_of(t) == [k for s in end.split(plain.lower()) if (k := s.strip(" .'’-"))]
        words = t.split()
        assert list(sentences.beginnings(words)) == [sentences.with_colon(" ".join(words[:n])) for n in range(1, min(7, len(words)))]


def test_label_codes(spark):
    df = spark.createDataFrame([("English",), ("FR",), ("UNKNOWN",), ("",), (None,), ("Mixed",)], "l string")
    assert [r[0] for r in df.select(languages.code(F.col("l"))).collect()] == ["en", "fr", None, None, None, "mixed"]


# -- personal information (problem 6)


def test_fold_keeps_offsets():
    t, at = personal.fold("Ａ​b é")
    assert t == "Ab é" and at == [0, 2, 3, 4]
    assert personal.fold("plain") == ("plain", None)


def test_personal_spans(spark, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/deid_requests.parquet").select(F.col("request_id").alias("id"), "text")
    more = [(10_001, "Patient Name: Quillan Marridge\nCall +965 36058432 or write to a.b@clinic.example.\nCivil ID: 280010684059"), (10_002, None), (10_003, ""), (10_004, "Checksum 10710415"), (10_001, "Patient Name: Quillan Marridge\nCall +965 36058432 or write to a.b@clinic.example.\nCivil ID: 280010684059")]
    df = src.unionByName(spark.createDataFrame(more, "id long, text string"))
    found = personal.personal_spans(df, ["id"])
    got = {(r.start_pos, r.end_pos, r.pii_type) for r in found.where("id = 10001").collect()}
    t = more[0][1]
    assert {(t[a:b], k) for a, b, k in got} >= {("+965 36058432", "PHONE"), ("a.b@clinic.example", "EMAIL"), ("280010684059", "ID")}
    assert found.where("id in (10002, 10003, 10004)").count() == 0
    masked = {r.id: r.masked for r in personal.masked(df.where("id > 10000").distinct(), found, ["id"]).collect()}
    assert "[PHONE]" in masked[10_001] and masked[10_002] is None and masked[10_004] == "Checksum 10710415"


def test_names_seen_a_few_times_stay_known_in_a_large_corpus(spark):
    some = [(i, "Patient Name: Quillan Marridge\nSeen at noon.") for i in range(3)] + [(10, "we told Quillan Marridge so"), (10, "we told Quillan Marridge so"), (None, "then Marridge's son came"), (11, "we told Ollan Tarridge so")]
    much = [(100 + i, "the scan was normal " * 10_000) for i in range(50)]
    for rows in (some, some + much):
        df = spark.createDataFrame(rows, "id int, text string")
        got = {(r.id, x.s, x.e) for r in personal.all_proposed(df, ["id"], "text").collect() for x in r.spans}
        assert got == {(0, 14, 30), (1, 14, 30), (2, 14, 30), (10, 8, 24), (None, 5, 13)}


def test_scans_that_look_for_beginnings_find_every_match():
    r = random.Random(6)
    parts = ["Dr. ", "Mme ", "Ann", "X.", "MRN-12-345678", "+965 ", "(212) ", "555-1234", "12/03/2020", " ", "\n", ". ", "اسم المريض: ", "سالم", "a", "Éa", "-", "ABCDEFG1234", "٣٤٥", "Am Hof 3", " street", "12 Oak Lane, ", "Calle Mayor, 3", "Name: ", "İ", "🙂", "Bergstraße 5", "P.O. Box 77", "شارع سالم 5", "ص. ب 12"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(4000)]
    spots = lambda it: [m.span() for m in it]
    for t, lines in zip(texts, personal.address_lines(texts, [t.lower() for t in texts])):
        for first, whole in ((personal.CODE_START, personal.CODE), (personal.NUMBER_START, personal.NUMBER), (personal.STRONG_START, personal.STRONG)):
            assert spots(personal.starts(first, whole, t)) == spots(whole.finditer(t))
        assert spots(personal.address_matches(t, lines)) == [x for p in personal.ADDRESSES for x in spots(p.finditer(t))]
        assert list(personal.first_words(t)) == re.findall(rf"(?:^|[.!?] |\n)\s*([{personal._UP}][{personal._LOW}]+)(?= [{personal._LOW}])", t)


def test_lines_without_an_address_are_not_tried():
    texts = ["ينصح بإعادة تصوير المثانة لمتابعة تصلب بقعي", "Die Temperatur im Bett betrug 84,9 °C", "a film of the knee\nLives at 12 Oak Lane, Denwick\nseen at noon"]
    assert personal.address_lines(texts, [t.lower() for t in texts]) == [[], [], [(19, 48)]]


def test_vote_model_trusts_agreeing_labelers():
    p = [((personal.PHONE, personal.PHONE), 90), ((personal.PHONE, -1), 40), ((-1, -1), 100), ((-1, personal.NONE), 60)]
    m = personal.vote_model(p, (personal.NONE, personal.PHONE))
    assert m[(personal.PHONE, personal.PHONE)][personal.PHONE] > 0.9 and m[(-1, personal.NONE)][personal.NONE] > 0.6


# -- queries


def test_columns(spark, sf_dir):
    want = {"p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "start_pos", "end_pos"], "p1_found": ["src_table", "row_id", "canonical"], "p3_found": ["src_table", "id_a", "id_b"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, sf_dir).columns == columns
