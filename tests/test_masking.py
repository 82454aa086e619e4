import hashlib
import hmac
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from maskwright.operators import masking as M
from maskwright.plans.pipeline import Deidentifier, resolve_types


def value(spark, column, text, kind="NAME"):
    return spark.createDataFrame([(text, kind)], "v string, k string").select(column(F.col("v"), F.col("k")).alias("x")).first().x


def test_strategies(spark):
    assert value(spark, M.redaction(), "abc") == "[REDACTED]"
    assert value(spark, M.redaction(mask_char="#"), "王小明") == "###"
    assert value(spark, M.partial(), "A123456789") == "A1******89"
    assert value(spark, M.partial(), "abcd") == "****"
    assert value(spark, M.partial(2, 0), "abcdef") == "ab****"
    assert value(spark, M.suppression(), "x") == ""
    assert value(spark, M.generalization(), "92 years", "AGE_OVER_89") == "≥90 years"
    assert value(spark, M.generalization(), "92", "AGE_OVER_90") == ">90歲"
    assert value(spark, M.generalization(), "05/03/2024", "DATE") == "05/0"
    assert value(spark, M.generalization(year_aware=True), "05/03/2024", "DATE") == "2024"
    assert value(spark, M.generalization(), "台北", "LOCATION") == "[地區]"
    assert value(spark, M.generalization(), "x", "SSN") == "[GENERALIZED]"
    digits = hashlib.sha256(b"saltBob").hexdigest()[:4].upper()
    assert value(spark, M.pseudonymization("salt"), "Bob") == f"Patient-{digits}"
    assert value(spark, M.pseudonymization("salt"), "Bob", "URL") == f"PSEUDO-{digits}"
    with pytest.raises(ValueError):
        M.strategy("none")


def test_dates(spark):
    shift = M.date_shifting(30)
    assert value(spark, shift, "2024-01-15") == "2024-02-14"
    assert value(spark, shift, "2024/1/5") == "2024-02-04"
    assert value(spark, shift, "2024年1月5日") == "2024-02-04"
    assert value(spark, shift, "15/01/2024") == "2024-02-14"
    assert value(spark, shift, "01/15/2024") == "2024-02-14"
    assert value(spark, shift, "soon") == "[DATE]"
    assert value(spark, M.date_shifting(20, preserve_year=True), "2024-12-25") == "2024-01-14"
    n = int.from_bytes(hashlib.sha256(b"doc-7").digest(), "big") % 731 - 365
    assert spark.range(1).select(M.seeded_offset(F.lit("doc-7")).alias("x")).first().x == n
    assert date(2024, 1, 1) + timedelta(days=n)


def test_service_masks(spark):
    expected = hmac.new(b"k" * 70, "李四".encode(), hashlib.sha256).hexdigest()
    assert spark.range(1).select(M.hmac_sha256("k" * 70, F.lit("李四")).alias("x")).first().x == expected
    one = lambda m, v="v", r=None: spark.range(1).select(M.service_mask(F.lit(v), F.lit("ID"), F.lit(m), F.lit(r).cast("string"), "s").alias("x")).first().x
    assert [one("delete"), one("keep"), one("generalize"), one("replace"), one("replace", r="R"), one("mask"), one("keep", "")] == ["", "v", "[ID]", "[ID]", "R", "[REDACTED]", "[REDACTED]"]


def test_texts_are_masked_without_leaks(spark):
    texts = ["mail a@b.org and a@b.org, ip 10.0.0.1", "none", "", None, "é a@b.org 王"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r for r in Deidentifier().run(df).collect()}
    assert rows[0].masked == "mail [REDACTED] and [REDACTED], ip [REDACTED]"
    assert rows[1].masked == "none" and rows[2].masked == "" and rows[3].masked is None
    assert rows[4].masked == "é [REDACTED] 王"
    assert all(r.valid for r in rows.values())
    only = Deidentifier(types=("IP_ADDRESS",)).run(df).filter("doc_id = 0").first()
    assert only.masked == "mail a@b.org and a@b.org, ip [REDACTED]"


def test_types_to_mask():
    assert resolve_types(["ID"]) == ("ID",)
    assert len(resolve_types()) == 7 and len(resolve_types(strict=True)) == 13


def test_tables_and_regeneration(spark):
    t = spark.createDataFrame([("Ann Lee", "Ann", None)], "a string, b string, c string")
    assert tuple(M.mask_table(t, [("Ann", "X"), ("Ann Lee", "Y"), ("", "Z")]).first()) == ("Y", "X", None)
    pairs = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(m).alias("masked")) for v, m in (("Ann", "X"), ("Ann Lee", "Y"))])
    assert t.select(M.replaced(F.col("a"), pairs).alias("x")).first().x == "Y"
    e = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(m).alias("masked"), F.lit(a).alias("start_pos"), F.lit(b).alias("end_pos")) for v, m, a, b in (("Ann", "X", 0, 3), ("Lee", "Y", 0, 3), ("Zed", "Z", 1, 4))])
    assert t.select(M.regenerated(F.col("a"), e).alias("x")).first().x == "X Y"
    assert M.preset("minimal").masking_of("NAME") == "mask"
