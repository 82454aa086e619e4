"""Formats of which nearly all values are needed."""

import warnings

import pytest

from maskwright.llm import surrogates

PIN = {"pin": r"#[0-9]{2}(?![0-9])"}


def made(spark, n):
    df = spark.createDataFrame([(i, f"a #{i:02d} b") for i in range(n)], "doc_id long, text string")
    return [r.text.split()[1] for r in surrogates.with_surrogates(df, "k", patterns=PIN).collect()]


def test_as_many_free_surrogates_as_values(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        out = made(spark, 50)
    assert len(set(out)) == 50 and not set(out) & {f"#{i:02d}" for i in range(50)}


def test_values_without_a_free_surrogate_are_reported(spark):
    with pytest.warns(UserWarning, match="20 values"):
        out = made(spark, 60)
    assert {f"#{i}" for i in range(60, 100)} <= set(out)
