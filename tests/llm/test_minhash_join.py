"""MinHash near-duplicates against a comparison of all pairs."""

import random

import numpy as np
import pytest

from maskwright.llm import minhash_join as M
from maskwright.llm.ngram_join import Words, shingle_set


def shingles(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def plain_groups(rows, size, num, den):
    sets = {d: shingles(t, size) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(r, n, words, changes, vocabulary=4000):
    base = [f"w{r.randrange(vocabulary)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = f"x{r.randrange(vocabulary)}"
        yield " ".join(w)


def corpus(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(40):
        texts += family(r, r.choice([1, 2, 3, 8]), r.choice([3, 8, 40, 200, 600]), r.choice([0, 1, 3, 8]))
    texts += family(r, 60, 300, 6)  # a list longer than all pairs are made for
    passage = " ".join(f"p{i}" for i in range(120))
    texts += [f"{passage} {t}" for t in family(r, 60, 100, 100, 100_000)]  # a passage that many share, too little for a link
    texts += [None, "", " \t ", "one", "one", "ONE", "one two", "Ä ö"]
    rows = list(enumerate(texts, 100))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "threshold", "all_pairs", "combine"), [(5, (85, 100), 32, 256), (5, (80, 100), 8, 4), (3, (90, 100), 2, 2)])
def test_groups_against_all_pairs(spark, size, threshold, all_pairs, combine):
    rows = corpus(size)
    df = spark.createDataFrame([(*x, "own") for x in rows], "doc_id long, text string, sig string").repartition(3)
    got = M.near_duplicates(df, size, threshold, all_pairs=all_pairs, combine=combine).collect()
    expected = plain_groups(rows, size, *threshold)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    assert len({c for _, c in expected.values()}) < len(rows) - 60


def test_collisions_estimate_the_similarity():
    r, words = random.Random(1), Words()
    for share in (0.5, 0.85, 0.95):
        counts = []
        for _ in range(150):
            base = [str(r.random()) for _ in range(400)]
            cut = round(400 * 2 * share / (1 + share))
            a, b = (np.unique(np.concatenate([shingle_set(x, 1, words) for x in (" ".join(base[:cut]), " ".join(str(r.random()) for _ in range(400 - cut)))])) for _ in range(2))
            counts.append((M.signature(a, 32) == M.signature(b, 32)).mean())
        assert abs(np.mean(counts) - share) < 0.02 and 0.5 < np.std(counts) / np.sqrt(share * (1 - share) / 32) < 1.5


def test_matches_and_prefixes():
    assert M.least_matches(32, 85, 100) == 15 and M.least_matches(32, 100, 100) == 32 and M.least_matches(32, 1, 100) == 1
    r = np.random.default_rng(3)
    counts = r.integers(0, 50, M.COUNTERS)
    for _ in range(300):  # two rows that agree in t places share one of their k - t + 1 rarest pairs
        a, b = r.integers(0, 1 << 63, (2, 32), dtype=np.uint64) * np.uint64(2)
        at = r.permutation(32)[:15]
        b[at] = a[at]
        x, y = M.prefixes(np.stack([a, b]), counts, 32 - 15 + 1)
        assert np.isin(x, y).any()


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d e f"), (None, None), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A B C D E F"), (8, None)]
    got = M.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, None, True), (None, 0, None, True), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (8, 0, 8, True)], key=repr)
    assert M.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(str(i % 70_001) for i in range(150_000))
    got = M.near_duplicates(spark.createDataFrame([(1, long), (2, long + " end")], schema)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1)]
