"""Names that cannot clash, archives, hints, scratch folders."""

import io
import os
import zipfile

from pyspark.sql import functions as F

from maskwright.functions.types import prefixed_custom
from maskwright.plans import reports, scratch
from maskwright.sources import outputs


def test_sheet_names_are_all_different(spark):
    long = "a" * 40
    names = [long, long, "a" * 27 + "_2", "a" * 27 + "_2", "x/y", "x_y", "b", None]
    df = spark.createDataFrame(list(enumerate(names)), "ord long, name string").filter("name is not null")
    got = [r.sheet for r in outputs.sheet_names(df).orderBy("ord").collect()]
    assert len(set(got)) == len(got) == 7 and all(len(x) <= 31 for x in got) and got[0] == "a" * 31 and got[6] == "b"


def test_archives_hold_every_file_under_a_name_of_its_own(spark, tmp_path):
    rows = [("a.txt", b"1"), ("a.txt", b"2"), ("A.txt", b"3"), ("a_2.txt", b"4"), ("noend", b"5"), ("noend", b"6"), (".hidden", b"7")]
    df = spark.createDataFrame(rows, "name string, bytes binary")
    told = outputs.write_archives(df, f"file://{tmp_path}/zips", archive_bytes=2).collect()
    found = {}
    for f in os.listdir(tmp_path / "zips"):
        with zipfile.ZipFile(io.BytesIO((tmp_path / "zips" / f).read_bytes())) as book:
            for n in book.namelist():
                assert n.lower() not in found
                found[n.lower()] = book.read(n)
    assert sorted(found.values()) == sorted(b for _, b in rows) and sum(r.files for r in told) == len(rows) and len(told) > 1


def test_hints_have_the_first_texts(spark):
    rows = [(1, "NAME", f"t{i % 9}", i / 100) for i in range(50)] + [(1, "DATE", None, 0.5), (2, "NAME", "x", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, phi_type string, text string, confidence double")
    got = {(r.doc_id, r.phi_type): (r.max_confidence, r.texts) for r in reports.hints(df).collect()}
    assert got == {(1, "NAME"): (0.49, ["t0", "t1", "t2", "t3", "t4"]), (1, "DATE"): (0.5, []), (2, "NAME"): (0.1, ["x"])}


def test_scratch_is_released(spark):
    path = scratch.fresh_path(spark, "mine")
    spark.range(3).write.parquet(path)
    mine = [path]
    scratch._MADE, kept = mine, scratch._MADE
    try:
        assert scratch.release(spark) == 1 and not os.path.exists(path.removeprefix("file://")) and scratch.release(spark) == 0
    finally:
        scratch._MADE = kept


def test_custom_names_of_any_length(spark):
    name = "CUSTOM:" + "n" * 1_200_000
    assert spark.range(1).select(F.length(prefixed_custom(F.lit(name))).alias("n")).first().n == 1_200_000
