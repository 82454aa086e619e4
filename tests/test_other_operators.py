import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions import types as Y
from maskwright.operators import chunking, evaluation, retrieval
from maskwright.plans import reports
from maskwright.plans.plugins import model_stage
from maskwright.operators import spans
from maskwright.sources import annotated, documents, outputs
from maskwright.streaming import documents as streams


def test_windows_cover_the_text(spark):
    texts = ["", "ab", "x" * 2000, "y" * 2001, "z" * 5803]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = chunking.windows(df).collect()
    for i, t in enumerate(texts):
        own = sorted((r.chunk_id, r.start_pos, r.end_pos, r.content) for r in rows if r.doc_id == i)
        assert all(t[a:b] == c for _, a, b, c in own)
        assert not t or own[-1][2] == len(t)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n,!", max_size=300), st.integers(20, 80), st.integers(0, 15))
def test_recursive_chunks_are_whole_and_bounded(text, size, overlap):
    bounds = chunking.recursive_bounds(text, size, overlap)
    assert all(0 < b - a <= size for a, b in bounds)
    covered = set()
    for a, b in bounds:
        covered.update(range(a, b))
    assert covered == set(range(len(text)))


def test_packed_lines(spark):
    t = "a" * 300 + "\n" + "b" * 150 + "\n" + "c" * 100
    assert spark.range(1).select(chunking.packed_lines(F.lit(t)).alias("x")).first().x == [t[:451], "c" * 100]


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.token_estimate(F.lit("病人abcd!! "))) == int(2 / 1.5 + 1 + 1.5)
    assert one(T.language(F.lit("abc 病"))) == "zh-TW" and one(T.language(F.lit("é"))) == "en"
    assert [one(T.duration(F.lit(x))) for x in (-1.0, 5.0, 125.0, 7300.0)] == ["計算中...", "5 秒", "2 分 5 秒", "2 小時 1 分"]
    assert one(T.file_size(F.lit(1536.0))) == "1.5 KB"
    assert one(T.rule_count(F.lit("1. a\n2. b\n- c"))) == 2
    assert [one(T.grade(F.lit(x)))[0] for x in (0.95, 0.8, 0.75, 0.5, 0.1)] == list("ABCDF")


def test_type_lookups(spark):
    labels = ["Name", "medical record number", "病歷號", "e-mail", "blood type", " ", None, "age"]
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    got = [(r.t.phi_type, r.t.custom_type) for r in df.select(Y.map_alias(F.col("x")).alias("t")).collect()]
    blank = ("CUSTOM", "Unknown PHI Type")
    assert got == [("NAME", None), ("MEDICAL_RECORD_NUMBER", None), ("MEDICAL_RECORD_NUMBER", None), ("EMAIL", None), ("CUSTOM", "blood type"), blank, blank, ("AGE_OVER_89", None)]
    assert Y.type_table(spark).count() == 28


def greedy(gold, predicted):
    used, tp = [False] * len(gold), 0
    for p in predicted:
        for i, g in enumerate(gold):
            if not used[i] and (p in g or g in p):
                used[i], tp = True, tp + 1
                break
    return tp


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "ab", "abc", "c", "d"]), max_size=5), st.lists(st.sampled_from(["a", "b", "bc", "cd"]), max_size=5)), min_size=10, max_size=10))
def test_greedy_matching(spark, cases):
    df = spark.createDataFrame([(g, p) for g, p in cases], "g array<string>, p array<string>")
    got = [r.x for r in df.select(evaluation.greedy_hits(F.col("g"), F.col("p")).alias("x")).collect()]
    assert got == [greedy(g, p) for g, p in cases]


def test_tags_and_answers(spark):
    t = "病人【PHI:NAME:1】王小明【/PHI】 【PHI:DATE】2024【/PHI】"
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [tuple(x) for x in one(evaluation.tags(F.lit(t)))] == [("NAME", "1", "王小明"), ("DATE", None, "2024")]
    assert one(evaluation.without_tags(F.lit(t))) == "病人王小明 2024"
    answers = ['```json\n{"entities": [{"text": "a", "phi_type": "ID"}]}\n```', 'x [{"text": "b", "phi_type": "ID"}] y', '"text": "c" oops "type": "ID"']
    assert [[tuple(e) for e in one(evaluation.parse_entities(F.lit(a)))] for a in answers] == [[("a", "ID")], [("b", "ID")], [("c", "ID")]]


def test_mmr_prefers_other_vectors(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.7, 0.7]), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, query array<float>")
    assert [r.vec_id for r in retrieval.mmr(queries, store, k=2, fetch=3, trade=0.3).orderBy("rank").collect()] == [1, 3]
    assert [r.vec_id for r in retrieval.top_k(queries, store, 2).orderBy("rank").collect()] == [1, 2]


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x \n y é".encode("latin-1"))
    (tmp_path / "b.json").write_text('{"resourceType": "Patient", "id": 1}')
    (tmp_path / "c.html").write_text("<html><script>no</script><p>Tom &amp; Al</p></html>")
    (tmp_path / "d.xml").write_text('<r a="1"><b>t</b>tail</r>')
    (tmp_path / "e.docx").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "f.xlsx", "w") as z:
        ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>name</t></si><si><t>Ann</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    rows = {r.path[-5:].strip("/"): r for r in documents.load(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].content == "x y é"
    by = {r.path.rpartition("/")[2]: r for r in rows.values()}
    assert by["c.html"].content == "Tom & Al"
    assert by["d.xml"].content == "r [a=1]\n  b: t"
    assert by["e.docx"].error == "BadZipFile" and by["e.docx"].content is None
    assert by["f.xlsx"].content == "[S] name: Ann"
    files = spark.createDataFrame([("f", "xlsx", bytearray((tmp_path / "f.xlsx").read_bytes())), ("g", "csv", bytearray(b"a;b\nAnn;1\n")), ("h", "pdf", bytearray(b""))], "path string, format string, bytes binary")
    pairs = spark.createDataFrame([("f", "Ann", "X"), ("g", "Ann", "Y")], "path string, value string, masked string")
    out = {r.path: r.bytes for r in outputs.masked_files(files, pairs).collect()}
    assert documents.xlsx_rows(bytes(out["f"]))["S"] == [["name"], ["X"]]
    assert bytes(out["g"]).decode("utf-8-sig").split() == ["a;b", "Y;1"] and out["h"] is None


def test_annotated_corpora(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"samples": [{"id": "1", "text": "Bob", "annotations": [{"value": "Bob", "label": "NAME", "start": 0, "end": 3}]}]}))
    samples, gold = annotated.read_annotated(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in samples.collect()] == [("1", "Bob")] and [tuple(r) for r in gold.collect()] == [("1", "Bob", "NAME", 0, 3)]
    pair = tmp_path / "pairs"
    pair.mkdir()
    (pair / "a.txt").write_text("Bob here")
    (pair / "a.xml").write_text('<NAME id="P0" start="0" end="3" text="Bob" />')
    (pair / "b.txt").write_text("alone")
    texts, gold = annotated.read_pairs(spark, str(pair))
    assert texts.count() == 2 and [tuple(r) for r in gold.collect()] == [("a", "Bob", "NAME", 0, 3)]


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = lambda n: spark.createDataFrame([(n, f"mail a{n}@b.org")], "doc_id int, text string")
    rows(1).write.parquet(source)
    stream = lambda: streams.deidentified_stream(streams.read_stream(spark, source, rows(0).schema)).select("doc_id", "masked")
    assert streams.run_available(stream(), out, check)["rows"] == 1
    rows(2).write.mode("append").parquet(source)
    assert streams.run_available(stream(), out, check)["rows"] == 1
    assert sorted(r.doc_id for r in spark.read.json(out).collect()) == [1, 2]


def test_reports_and_plugins(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "b", "ValueError"), (3, "tom", None)], "doc_id int, text string, error string").withColumn("spans", spans.no_spans())
    job = reports.job_result(docs).first()
    assert (job.documents, job.failed, job.status, job.errors[0].error) == (3, 1, "partial", "ValueError")

    def load():
        def model(text):
            if text == "b":
                raise KeyError("hidden")
            at = text.find("tom")
            return [{"phi_type": "NAME", "text": "tom", "start_pos": at, "end_pos": at + 3, "confidence": 0.9}] if at >= 0 else []

        return model

    rows = {r.doc_id: r for r in docs.transform(model_stage(load, "ner")).collect()}
    assert rows[3].spans[0].text == "tom" and rows[2].ner_error == "KeyError" and rows[1].spans == []


def test_core_queries_stay_in_the_jvm(spark):
    from maskwright.queries import QUERIES

    for name in ("phi_type_distribution", "apply_mask_docs", "merge_overlaps", "chunk_windows", "eval_exact", "latest_per_key"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


def test_sql_functions_and_exports(spark, tmp_path):
    import io

    from maskwright.functions.sql import register
    from maskwright.sources import catalogue

    register(spark)
    row = spark.sql("select mask_partial('A123456789', 2, 2) a, pseudonym('x', 's') b, collapse_spaces(' a \n b ') c, text_language('病') d, phone_digits('+1 (2)') e, strip_tags('a【PHI:ID:1】b【/PHI】') f").first()
    assert (row.a, row.c, row.d, row.e, row.f) == ("A1******89", "a b", "zh-TW", "+12", "ab") and row.b.startswith("PSEUDO-")
    out = spark.createDataFrame([("a.csv", bytearray(b"1")), ("a.csv", bytearray(b"2"))], "name string, bytes binary")
    assert sorted(zipfile.ZipFile(io.BytesIO(catalogue.packed(out))).namelist()) == ["a.csv", "a_2.csv"]
    with pytest.raises(ValueError):
        catalogue.packed(out, 1)
    (tmp_path / "law").mkdir()
    (tmp_path / "law" / "a.md").write_text("# rule\ntext")
    assert [tuple(r) for r in annotated.read_regulations(spark, str(tmp_path)).collect()] == [("a.md", "law", "# rule\ntext")]
    tagged = spark.createDataFrame([(1, "x【PHI:ID】y【/PHI】", "none")], "id int, a string, b string")
    assert [r.column for r in annotated.read_tagged(tagged, "id").collect()] == ["a"]
