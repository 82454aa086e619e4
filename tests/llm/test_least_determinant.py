"""The robust estimate against a plain search for the smallest determinant, and planted outliers."""

import numpy as np
import pytest

from maskwright.llm import robust_outliers as R

KEYS = [f"l{i}{j}" for i in range(5) for j in range(i + 1)]


def plain_least(x, rng, starts=60):
    """Least log determinant of the floored covariance of three quarters of the rows, by concentration from random subsets."""
    n, h = len(x), int(np.ceil(0.75 * len(x)))
    best = (np.inf, None, None)
    for _ in range(starts):
        some = rng.choice(n, 12, replace=False)
        last = np.inf
        while True:
            centre, cov = x[some].mean(0), np.cov(x[some].T, bias=True) + np.diag(np.square(R.FLOOR))
            det = np.linalg.slogdet(cov)[1]
            if len(some) == h and det >= last - 1e-9:
                break
            last = det if len(some) == h else np.inf
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            some = np.argsort(d, kind="stable")[:h]
        if det < best[0]:
            best = det, centre, cov
    return best


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(5, 5)) * 0.4
    clean = rng.normal(size=(300, 5)) @ mix + [5, 6, 1, 1, 0]
    spoilt = np.concatenate([clean[:260], [5, 6, 1, 1, 0] + rng.normal(size=(40, 5)) * 0.1 + [6, -4, 5, 4, 5]])  # close together: a classical estimate hides them
    return {"a": clean, "b": spoilt}


def test_determinant_is_as_small_as_a_plain_search_finds(spark, groups):
    rows = [(k, "=s", *map(float, v)) for k, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    found = {r["lang"]: r for r in R.estimate(df).collect()}
    for name, x in groups.items():
        det, centre, cov = plain_least(x, np.random.default_rng(1))
        m = found[name]["m"]
        low = np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                low[i, j] = m[f"l{i}{j}"]
        assert m["logdet"] <= det + 0.15, name  # a cut takes its whole bin, so some more rows lie within
        assert np.allclose([m[f"c{i}"] for i in range(5)], centre, atol=0.15)
        own, plain = (np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(v), x - c) for c, v in (([m[f"c{i}"] for i in range(5)], low @ low.T), (centre, cov)))
        own, plain = (d / max(np.median(d) / R.CHI2_MEDIAN, 1) > R.CHI2_CUT for d in (own, plain))
        assert (own == plain).mean() > 0.99
    assert own[260:].all() and not own[:260].any()


def test_planted_outliers_are_caught_in_every_language(spark):
    rng = np.random.default_rng(6)
    word = lambda k: "".join(rng.choice(list("abcdefghij"), max(1, int(rng.normal(k, 2)))))
    prose = lambda n, k=6: " ".join(word(k) for _ in range(n))
    rows, i = [], 0
    for lang, k in (("en", 5), ("de", 8), (None, 6)):
        for _ in range(120):
            rows.append((i, prose(int(np.exp(rng.normal(5, 0.5))) + 50, k), lang, f"s{i % 2}"))
            i += 1
        for bad in (
            " ".join(f"{word(k)} |#|" for _ in range(150)),
            " ".join(word(k) * 6 for _ in range(80)),
            "\n".join([prose(8, k)] * 4 + [prose(8, k) for _ in range(8)]),
            " ".join(c for c in prose(60, k) if c != " "),
        ):
            rows.append((-i - len(rows), bad, lang, f"s{i % 2}"))
    out = R.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    bad = [r for r in out if r.doc_id < 0]
    assert np.mean([not r.kept for r in bad]) >= 0.9 and np.mean([r.kept for r in out if r.doc_id >= 0]) > 0.99
