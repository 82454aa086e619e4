"""Queries over readers and writers of files that are made from the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from maskwright.operator_queries import _files, _loaded
from maskwright.operators import rules, spans
from maskwright.plans import plugins
from maskwright.plans.scratch import fresh_path
from maskwright.queries import query, table
from maskwright.sources import annotated, office, outputs
from maskwright.sources import documents as sources
from maskwright.streaming import documents as streams


def nations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


# ---------------------------------------------------------------- readers


@query("SELECT n_regionkey AS file, string_agg(n_name || ', ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey")
def load_csv_without_header(spark, d):
    each = nations(spark, d).groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))  # a few rows a region
    lines = F.array_join(F.transform("x", lambda r: F.concat(F.lit('"'), r["n_name"], F.lit('",'), r["n_nationkey"].cast("string"))), "\n")
    path = _files(spark, each.select(F.col("n_regionkey").alias("file"), lines.alias("value")), "text")
    return _loaded(spark, path, format="csv", glob="*.txt", readers={"csv": sources.csv_reader(header=False)}).select("file", "content")


_SHEET_LINE = "'n_nationkey: ' || n_nationkey || ', n_name: ' || n_name"


@query(f"SELECT '[' || n_regionkey || '] ' || {_SHEET_LINE} AS line FROM nation")
def load_xlsx(spark, d):
    """Workbooks of several sheets as text."""
    path = fresh_path(spark, "workbooks")
    office.write_sheets(nations(spark, d), path, "n_regionkey", 2)
    return sources.load(spark, path, format="xlsx", glob="*.xlsx").select(F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")


@query(f"SELECT '[3] ' || {_SHEET_LINE} AS line FROM nation WHERE n_regionkey = 3")
def load_xlsx_sheet(spark, d):
    path = fresh_path(spark, "workbooks")
    office.write_sheets(nations(spark, d), path, "n_regionkey", 1)
    found = sources.load(spark, path, format="xlsx", glob="*.xlsx", readers={"xlsx": sources.sheet_reader("3")})
    return found.select(F.explode(F.split("content", "\n")).alias("line"))


def docx_files(rows):
    """name and bytes of word files, a paragraph for each line of ``text`` and a table with a cell of it."""

    def make(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                paragraph = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
                body = "".join(map(paragraph, text.split("\n"))) + f"<w:tbl><w:tr><w:tc>{paragraph('cell')}</w:tc><w:tc>{paragraph(text[:3])}</w:tc></w:tr></w:tbl>"
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as book:
                    book.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
                out.append(data.getvalue())
            yield pd.DataFrame({"name": pdf["name"], "bytes": out})

    return rows.select("name", "text").mapInPandas(make, "name string, bytes binary")


def _docx(spark, d):
    return docx_files(nations(spark, d).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".docx")).alias("name"), F.concat(F.lit("of "), "n_name", F.lit("\nend")).alias("text")))


@query("SELECT n_nationkey AS file, 'of ' || n_name || chr(10) || 'end' || chr(10) || '--- Tables ---' || chr(10) || 'cell | of' AS content FROM nation")
def load_docx(spark, d):
    path = fresh_path(spark, "words")
    outputs.write_files(_docx(spark, d), path)
    found = sources.load(spark, path, glob="*.docx")
    return found.select(F.regexp_extract("path", r"n([0-9]+)\.docx$", 1).cast("int").alias("file"), F.col("content"))


@query("SELECT n_nationkey AS file, 'text' AS format, length(n_name) + 1 AS length, n_name AS content, TRUE AS dated FROM nation")
def load_metadata(spark, d):
    """Size and time of files beside their content."""
    path = _files(spark, nations(spark, d).select(F.col("n_nationkey").alias("file"), F.col("n_name").alias("value")), "text")
    dated = (F.col("modified") > F.lit("2020-01-01").cast("timestamp")).alias("dated")
    return _loaded(spark, path, glob="*.txt", metadata=True).select("file", "format", "length", "content", dated)


@query("SELECT n_nationkey AS file, upper(n_name) || '!' AS content FROM nation")
def load_registered(spark, d):
    """A reader that the caller registers in place of the library's."""
    path = _files(spark, nations(spark, d).select(F.col("n_nationkey").alias("file"), F.lower("n_name").alias("value")), "text")
    return _loaded(spark, path, format="text", glob="*.txt", readers={"text": lambda data: data.decode().strip().upper() + "!"}).select("file", "content")


@query("SELECT c_custkey, 'c' || c_custkey AS sample_id, 'Customer#' AS first, c_name AS text, 'NAME' AS phi_type, 4 AS start, 4 + length(c_name) AS \"end\" FROM customer")
def synthetic_spans(spark, d):
    """Generated samples with spans by position."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    one = F.struct(F.lit("NAME").alias("entity_type"), F.col("c_name").alias("entity_value"), F.lit(4).alias("start_position"), (F.char_length("c_name") + 4).alias("end_position"))
    path = fresh_path(spark, "samples") + ".jsonl"
    rows.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("for "), "c_name").alias("full_text"), F.array(one).alias("spans")).write.json(path)
    samples, gold = annotated.read_annotated(spark, path)
    out = samples.withColumnRenamed("text", "whole").join(gold, "sample_id")
    first = F.expr("substring(whole, start + 1, 9)")
    return out.select(F.substring("sample_id", 2, 20).cast("long").alias("c_custkey"), "sample_id", first.alias("first"), "text", "phi_type", "start", "end")


@query("SELECT 'file=' || n_nationkey AS type, n_name || chr(10) || 'rule' || chr(10) AS content FROM nation")
def regulations_read(spark, d):
    rows = nations(spark, d).select(F.col("n_nationkey").alias("file"), F.concat("n_name", F.lit("\nrule")).alias("value"))
    return annotated.read_regulations(spark, _files(spark, rows, "text")).select("type", "content")


@query("SELECT 's' || n_nationkey AS sample_id, n_name AS text, 'NATION' AS phi_type, 3 AS start, 3 + length(n_name) AS \"end\" FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 's' || n_nationkey, n_name, 'REGION', NULL, NULL FROM nation WHERE n_nationkey % 4 = 1")
def annotation_pairs(spark, d):
    """Texts and annotation files of the same stem: with attributes, with inline tags, without."""
    key, n = F.col("n_nationkey"), F.col("n_name")
    stem = F.concat(F.lit("s"), key.cast("string"))
    inline = F.concat(F.lit('to <PHI TYPE="REGION">'), n, F.lit("</PHI>"))
    with_places = F.concat(F.lit('<d><NATION id="1" start="3" end="'), (3 + F.char_length(n)).cast("string"), F.lit('" text="'), n, F.lit('"/></d>'))
    texts = nations(spark, d).select(F.concat(stem, F.lit(".txt")).alias("name"), F.encode(F.concat(F.lit("to "), n), "UTF-8").alias("bytes"))
    notes = nations(spark, d).filter(key % 4 != 3).select(F.concat(stem, F.when(key % 2 == 0, ".xml").otherwise(".phi")).alias("name"), F.encode(F.when(key % 2 == 0, with_places).otherwise(inline), "UTF-8").alias("bytes"))
    path = fresh_path(spark, "pairs")
    outputs.write_files(texts.unionByName(notes), path)
    return annotated.read_pairs(spark, path)[1].select("sample_id", "text", "phi_type", "start", "end")


@query("SELECT 's' || n_nationkey AS sample_id, 'to ' || n_name || '.' AS whole, n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'COUNTRY' ELSE 'PLACE' END AS phi_type, CASE WHEN n_nationkey % 2 = 0 THEN 3 END AS start FROM nation")
def annotation_marked(spark, d):
    """Files that hold text and tags: inline, or with attributes in another order than usual."""
    key, n = F.col("n_nationkey"), F.col("n_name")
    inline = F.concat(F.lit('to <PHI TYPE="PLACE">'), n, F.lit("</PHI>."))
    placed = F.concat(F.lit("to "), n, F.lit('.<NATION TYPE="COUNTRY" text="'), n, F.lit('" end="'), (3 + F.char_length(n)).cast("string"), F.lit('" start="3"/>'))
    rows = nations(spark, d).select(F.concat(F.lit("s"), key.cast("string"), F.lit(".xml")).alias("name"), F.encode(F.when(key % 2 == 0, placed).otherwise(inline), "UTF-8").alias("bytes"))
    path = fresh_path(spark, "marked")
    outputs.write_files(rows, path)
    samples, gold = annotated.read_marked(spark, path)
    return samples.withColumnRenamed("text", "whole").join(gold, "sample_id").select("sample_id", "whole", "text", "phi_type", "start")


# ---------------------------------------------------------------- writers


@query("SELECT n_regionkey AS region, count(*) AS nations FROM nation GROUP BY n_regionkey")
def report_as_json(spark, d):
    """A report written as one JSON file and read again."""
    path = fresh_path(spark, "report")
    outputs.write_report(nations(spark, d).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations")), path)
    return spark.read.schema("region int, nations long").json(path)


def _unzipped(batches):
    for pdf in batches:
        rows = [(n, book.read(n).decode()) for data in pdf["content"] for book in [zipfile.ZipFile(io.BytesIO(bytes(data)))] for n in book.namelist()]
        yield pd.DataFrame(rows, columns=["name", "content"])


@query("SELECT CASE WHEN r = 1 THEN 'r' || n_regionkey || '.txt' ELSE 'r' || n_regionkey || '_' || r || '.txt' END AS name, count(*) AS files FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) GROUP BY 1")
def zip_archives(spark, d):
    """Several archives of files of which some have the same name."""
    path = fresh_path(spark, "archives")
    rows = nations(spark, d).select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".txt")).alias("name"), F.encode("n_name", "UTF-8").alias("bytes"))
    outputs.write_archives(rows, path, archive_bytes=60)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    return found.mapInPandas(_unzipped, "name string, content string").groupBy("name").agg(F.count("*").alias("files"))


@query("SELECT n_nationkey AS file, 'of [N]' || chr(10) || 'end' AS content FROM nation")
def docx_masked(spark, d):
    """Word files with their values masked, whatever runs they stand in."""
    files = _docx(spark, d).select(F.col("name").alias("path"), F.lit("docx").alias("format"), "bytes")
    pairs = nations(spark, d).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".docx")).alias("path"), F.col("n_name").alias("value"), F.lit("[N]").alias("masked"))
    masked = outputs.masked_files(files, pairs)

    def text(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "content": [sources.docx_text(bytes(b)).split("\n---")[0] for b in pdf["bytes"]]})

    return masked.select("path", "bytes").mapInPandas(text, "path string, content string").select(F.regexp_extract("path", "([0-9]+)", 1).cast("int").alias("file"), "content")


@query("SELECT n_nationkey, '[N]' AS name FROM nation")
def xlsx_masked(spark, d):
    """Workbooks with their values masked, cell by cell."""
    path = fresh_path(spark, "workbooks")
    office.write_sheets(nations(spark, d).select("n_nationkey", F.col("n_name").alias("name"), "n_regionkey"), path, "n_regionkey", 2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", F.lit("xlsx").alias("format"), F.col("content").alias("bytes"))
    pairs = files.select("path").crossJoin(F.broadcast(nations(spark, d).select(F.col("n_name").alias("value"), F.lit("[N]").alias("masked"))))  # two files

    def rows(batches):
        for pdf in batches:
            cells = [(int(r[0]), r[1]) for b in pdf["bytes"] for sheet in sources.xlsx_rows(bytes(b)).values() for r in sheet[1:]]
            yield pd.DataFrame(cells, columns=["n_nationkey", "name"])

    return outputs.masked_files(files, pairs).select("bytes").mapInPandas(rows, "n_nationkey int, name string")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0")
def expired_deleted(spark, d):
    """What is left of a folder when expired files are gone."""
    path = fresh_path(spark, "expiring")
    rows = nations(spark, d).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.encode("n_name", "UTF-8").alias("bytes"))
    outputs.write_files(rows, path)
    listed = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", "n([0-9]+)$", 1).cast("int").alias("k"))
    aged = listed.select("path", F.when(F.col("k") % 3 == 0, F.lit("2024-01-01")).otherwise("2024-06-01").cast("timestamp").alias("modified"))
    outputs.delete_expired(spark, aged, F.lit("2024-06-02").cast("timestamp"), 48)
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "n([0-9]+)$", 1).cast("int").alias("n_nationkey"))


# ---------------------------------------------------------------- plug-ins and streams


def _first_word():
    def model(text):
        if len(text) % 7 == 0:
            raise ValueError(text)
        return [{"phi_type": "NAME", "text": text[:4], "start_pos": 0, "end_pos": 4, "confidence": 0.9}]

    return model


@query("SELECT c_custkey, CASE WHEN length(t) % 7 = 0 THEN '' ELSE 'Cust' END AS found, CASE WHEN length(t) % 7 = 0 THEN 'ValueError' END AS error FROM (SELECT c_custkey, c_name || c_mktsegment AS t FROM customer)")
def plugin_threads(spark, d):
    """A model called by several threads of a task; its failures stay with their texts."""
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_name", "c_mktsegment").alias("text"), spans.no_spans().alias("spans"))
    out = plugins.model_stage(_first_word, "model", threads=4)(rows)
    return out.select("c_custkey", F.array_join(F.transform("spans", lambda s: s["text"]), ",").alias("found"), F.col("model_error").alias("error"))


def _labels():
    return lambda text: [{"label": text.split("|")[1], "text": text.split("|")[0], "start_pos": 0, "end_pos": text.index("|")}]


@query("SELECT c_custkey, CASE WHEN k = 0 THEN 'NAME' WHEN k = 1 THEN 'HOSPITAL_NAME' WHEN k = 2 THEN 'LOCATION' ELSE '' END AS found, CASE WHEN k = 0 THEN '0.85' WHEN k = 1 THEN '0.75' WHEN k = 2 THEN '0.8' ELSE '' END AS confidence FROM (SELECT c_custkey, c_custkey % 5 AS k FROM customer)")
def plugin_labels(spark, d):
    """A recogniser's own labels as types with their confidence: unlisted ones and those under the least confidence are left out."""
    k = F.col("c_custkey") % 5
    label = F.when(k == 0, "PERSON").when(k == 1, "ORG").when(k == 2, "GPE").when(k == 3, "CARDINAL").otherwise("UNLISTED")
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("|"), label).alias("text"), spans.no_spans().alias("spans"))
    out = plugins.model_stage(_labels, "recogniser", least=0.6, labels=plugins.ENTITY_LABELS)(rows)
    listed = lambda c: F.array_join(F.transform("spans", lambda s: s[c].cast("string")), ",")
    return out.select("c_custkey", listed("phi_type").alias("found"), listed("confidence").alias("confidence"))


@query("SELECT event_id, 2 AS times FROM events")
def stream_reset(spark, d):
    """A query whose checkpoint is reset begins again."""
    source = table(spark, d, "events").select("event_id")
    path, out, checkpoint = (fresh_path(spark, x) for x in ("stream-in", "stream-out", "stream-checkpoint"))
    source.write.parquet(path)
    run = lambda n: streams.run_available(streams.read_stream(spark, path, source.schema), f"{out}/{n}", checkpoint)
    run("a")
    streams.reset(spark, checkpoint)
    run("b")
    seen = spark.read.schema(source.schema).json([f"{out}/a", f"{out}/b"])
    return seen.groupBy("event_id").agg(F.count("*").cast("int").alias("times"))


@query("SELECT doc_id, n AS spans FROM (SELECT doc_id, len(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b')) AS n FROM documents) WHERE n > 0")
def stream_masked(spark, d):
    """Documents of a stream through detection, masking and validation; how many addresses each had."""
    from maskwright.plans.pipeline import Deidentifier

    source = table(spark, d, "documents").select("doc_id", "text")
    path, out, checkpoint = (fresh_path(spark, x) for x in ("stream-in", "stream-out", "stream-checkpoint"))
    source.write.parquet(path)
    engine = Deidentifier(detectors=[lambda t: spans.scan(t, rules.of_type(rules.PARITY, "EMAIL"))])
    found = streams.deidentified_stream(streams.read_stream(spark, path, source.schema), engine)
    streams.run_available(found.filter("size(spans) > 0 and valid").select("doc_id", F.size("spans").cast("long").alias("spans")), out, checkpoint)
    return spark.read.schema("doc_id long, spans long").json(out)
