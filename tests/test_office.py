"""Workbooks and word files as data sources."""

import io
import os
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from maskwright.sources import office
from maskwright.sources.documents import xlsx_rows

ODD = ["plain", " spaces  ", "a<b>&\"c\"", "line\nbreak\ttab", "bell\x07", "_x0041_", "_x_", "😀王", "", None, "1e3", "\r"]


def test_roundtrip_of_odd_cells(spark, tmp_path):
    office.register(spark)
    path = f"file://{tmp_path}/books"
    schema = "id long, t string, x double, b boolean, d date, big long"
    rows = [(i, t, [1.5, -0.0, 1e300, 0.1 + 0.2, None][i % 5], [True, False, None][i % 3], date(2024, 2, 29) if i % 2 else None, 2**62 + i) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, schema)
    office.write_sheets(df, path, files=2)
    got = spark.read.format("workbooks").schema(schema).load(path).orderBy("id").collect()
    assert [tuple(r) for r in got] == rows
    files = [f for f in os.listdir(tmp_path / "books") if f.endswith(".xlsx")]
    assert len(files) == 2
    assert sum(len(r) - 1 for f in files for r in xlsx_rows((tmp_path / "books" / f).read_bytes()).values()) == len(rows)  # the other reader opens them, too
    office.write_sheets(df.limit(3), path, files=1, mode="append")
    assert spark.read.format("workbooks").option("header", "false").load(path).count() == len(rows) + 3 + 3  # and the headers of three files
    office.write_sheets(df.limit(1), path, files=1)
    assert [f.endswith(".xlsx") for f in os.listdir(tmp_path / "books")].count(True) == 1


def test_sheets_by_column_and_full_sheets(spark, tmp_path):
    office.register(spark)
    path = f"file://{tmp_path}/books"
    df = spark.range(60).select("id", F.concat(F.lit("a very long name: of sheets [no.] "), (F.col("id") % 3).cast("string")).alias("s"))
    office.write_sheets(df, path, "s", 1)
    seen = spark.read.format("workbooks").schema("__sheet string, id long").load(path).groupBy("__sheet").count().collect()
    assert sorted(r["count"] for r in seen) == [20, 20, 20] and all(len(r["__sheet"]) <= 31 for r in seen)
    df.coalesce(1).write.format("workbooks").option("sheetRows", 8).option("sheet", "All").mode("overwrite").save(path)
    got = spark.read.format("workbooks").schema("id long, __sheet string, __row long").option("perSheet", "true").load(path)
    assert got.count() == 60 and got.select("__sheet").distinct().count() == 9 and got.agg(F.max("__row")).first()[0] == 8
    raw = spark.read.format("workbooks").option("sheet", "All").option("header", "false").load(path).orderBy("__row").first()
    assert raw.cells == ["id", "s"]


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    office.register(spark)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("workbooks").mode("append").save(f"file://{tmp_path}/books")
    assert not os.path.isdir(tmp_path / "books") or os.listdir(tmp_path / "books") == []


def test_word_files(spark, tmp_path):
    office.register(spark)
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("One") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>" + p("Two")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "x.docx").write_bytes(data.getvalue())
    got = spark.read.format("wordfiles").load(f"file://{tmp_path}").orderBy("item").collect()
    assert [(r["item"], r.kind, r.text) for r in got] == [(0, "paragraph", "One"), (1, "row", "a | b"), (2, "paragraph", "Two")]
