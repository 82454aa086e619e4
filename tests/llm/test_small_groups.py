"""Outliers of groups too small for an estimate of their own."""

import random

import numpy as np

from maskwright.llm import robust_outliers


def test_small_groups_are_judged_by_language_and_corpus(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(max(1, int(rng.gauss(6, 2))))) for _ in range(n))
    junk = lambda: " ".join(f"{prose(1)} |#|" for _ in range(150))
    rows = [(i, prose(rng.randint(60, 300)), "en", f"s{i % 30}") for i in range(240)]  # 8 a source, the language has enough
    rows += [(1000 + i, junk(), "en", f"s{i}") for i in range(5)]
    rows += [(2000, prose(120), "xx", None), (2001, junk(), None, "y")]  # languages of a document: by the corpus
    rows += [(3000 + i, prose(rng.randint(60, 300)), "de", "") for i in range(60)] + [(3100, junk(), "de", "")]
    out = {r.doc_id: r for r in robust_outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(out) == len(rows) and all(r.distance is not None for r in out.values() if not r.base_failed)
    assert not any(out[i].kept for i in (1000, 1001, 1002, 1003, 1004, 2001, 3100))
    assert out[2000].kept and np.mean([r.kept for i, r in out.items() if i < 1000 or 3000 <= i < 3100]) > 0.99


def test_a_corpus_below_the_least_size_has_distances_too(spark):
    rows = [(i, " ".join(f"word{i}{k}" for k in range(60 + i)), "en", "s") for i in range(3)]
    out = robust_outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept and r.distance is not None for r in out)
