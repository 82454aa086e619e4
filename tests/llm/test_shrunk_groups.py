"""Estimates of groups drawn towards their language's by their number of documents."""

import random

import numpy as np
from pyspark.sql import functions as F

from maskwright.llm import robust_outliers as R


def test_models_lie_between_their_own_and_the_one_above(spark):
    rng = np.random.default_rng(2)
    rows = []
    for lang, source, n, shift in (("en", "a", 400, 0.0), ("en", "b", 20, 2.0), ("de", "a", 150, -1.0), ("", "", 3, 0.5)):
        rows += [(lang, source, *map(float, rng.normal(size=5) * [1, 2, 0.5, 1, 0.3] + shift)) for _ in range(n)]
    names = [f"x{i}" for i in range(5)]
    fit = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} double" for c in names))
    own = R.estimate(R._dealt(fit))
    got = {(r.lang, r.source): r for r in R._shrunk(own, fit, 50.0).collect()}
    model = {(r.lang, r.source): r for r in own.collect()}

    def parts(r):
        low = np.array([[r.m[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        return np.array([r.m[f"c{i}"] for i in range(5)]), low @ low.T, r.scale

    def mixed(a, b, n):
        w = n**2 / (n**2 + 50**2)
        return tuple(w * x + (1 - w) * y for x, y in zip(a, b, strict=True))

    sizes = {("en", "a"): 400, ("en", "b"): 20, ("de", "a"): 150, ("", ""): 3}
    for (lang, source), n in sizes.items():
        in_lang = sum(m for (x, _), m in sizes.items() if x == lang)
        above = mixed(parts(model[f"={lang}", ""]), parts(model["", ""]), in_lang)
        expected = mixed(parts(model[f"={lang}", f"={source}"]), above, n)
        for a, b in zip(parts(got[lang, source]), expected, strict=True):
            assert np.allclose(a, b, atol=1e-8)


def test_the_verdict_follows_the_group_smoothly(spark):
    """A style that is odd in its language is accepted where a source has enough of it, and rejected where it is rare."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    prose = lambda: " ".join(word(rng.randint(3, 8)) for _ in range(rng.randint(60, 200)))
    long = lambda: " ".join(word(rng.randint(27, 33)) for _ in range(rng.randint(60, 200)))
    rows = [(i, prose(), "en", "web") for i in range(300)] + [(1000 + i, long(), "en", "dna") for i in range(300)] + [(2000, long(), "en", "web"), (2001, None, "en", "web")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, source string, distance string")
    out = {r.doc_id: r for r in R.judge(df).collect()}
    assert not out[2000].kept and not out[2001].kept
    assert np.mean([out[i].kept for i in range(300)]) > 0.98 and np.mean([out[1000 + i].kept for i in range(300)]) > 0.98
    again = R.judge(df.unionByName(df.filter("doc_id < 5"))).groupBy("doc_id").agg(F.count_distinct("distance").alias("n")).filter("n > 1")
    assert again.count() == 0  # repeated rows are judged alike
