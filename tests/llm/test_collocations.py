"""Collocations against plain counting, and the transducers against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(texts, depth):
    out = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\n-\r]", (t or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    out[tuple(w[i : i + m])] += 1
    return out


def plain(rows, longest, least, top, covered):
    out = []
    for lang in {x or "und" if x is None else x for _, x in rows}:
        f = grams([t for t, x in rows if ("und" if x is None else x) == lang], longest)
        some = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + m] for g, a in some.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if covered[1] * a >= covered[0] * f[g[i : i + m]]}
        n = sum(a for g, a in f.items() if len(g) == 1)
        found = []
        for g, a in some.items():
            if g not in gone:
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed, n=300):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(30)] + ["Ä", "é", "日本", "x y", "ZZ"]
    fixed = ["new york city hall", "united states", "in the middle of", "a b", "w1 w2"]
    for i in range(n):
        words = []
        for _ in range(r.choice([0, 3, 40, 120])):
            words.append(r.choice(fixed) if r.random() < 0.3 else r.choice(common) if r.random() < 0.9 else f"rare{r.randrange(10**6)}")
            if r.random() < 0.1:
                words[-1] += r.choice([".", ",", "\n", " ! ", "\t", "\x0b", "::"])
        yield " ".join(words), r.choice(["en", "en", "en", "de", None, ""])
    yield None, "en"
    yield "...", "fr"
    yield " ".join(["same"] * 500), "de"


@pytest.mark.parametrize(("longest", "least", "top", "size"), [(4, 30, 2000, 1 << 24), (4, 3, 25, 2000), (2, 5, 50, 5000), (3, 1, 2000, 40_000)])
def test_phrases_against_plain_counting(spark, longest, least, top, size):
    rows = list(corpus(longest + least))
    df = spark.createDataFrame([(i, *x, 1) for i, x in enumerate(rows)], "doc_id long, text string, lang string, n long").repartition(5)
    got = C.mine(df, longest, least, top, range_bytes=size, range_phrases=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = plain(rows, longest, least, top, (80, 100))
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 20


def test_odd_tables(spark):
    schema = "text string, lang string"
    assert C.mine(spark.createDataFrame([], schema)).count() == 0
    assert C.mine(spark.createDataFrame([(None, None), ("", "en"), (" .", "en")], schema), min_count=1).count() == 0
    long = "Of the. " * 400_000  # several stretches of one text
    (row,) = C.mine(spark.createDataFrame([(long, None)], schema)).collect()
    assert tuple(row) == ("und", 1, "of the", 400_000, 400_000, 400_000, 800_000, 1_000_000)


def test_counts_may_pass_64_bits():
    big = 10**18
    t = C.Transducer([b"a", b"b"], [np.array([2 * big, big]), np.array([big])], [None, np.array([0])], [None, np.array([1])])
    t = C.Transducer.unpacked(t.packed())
    (p, message), = C._messages(t, "en", 1)
    answers, around = C._answered(t, [message])
    assert C._scored(t, "en", 1, {p: answers[0]}, around, (80, 100), 9) == [("en", "a b", big, 2 * big, big, 2_000_000 * big // (3 * big))]


def test_transducers_against_dictionaries():
    r = random.Random(5)
    whole, some = Counter(), []
    for _ in range(7):
        texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 60))) for _ in range(5)]
        shard = C.Shard()
        for t in texts:
            shard.add(t)
        t = shard.transducer(4)
        own = grams(texts, 4)
        read = lambda t: {tuple(t.words[i].decode() for i in p): w for k in range(4) for p, w in zip(t.paths(k).tolist(), t.weights[k].tolist(), strict=True) if w}
        assert read(t) == own
        parts = dict(C.cut(t, "en", 8))
        joined = Counter()
        for x in parts.values():
            assert not joined.keys() & read(x).keys()
            joined.update(read(C.Transducer.unpacked(x.packed())))
        assert joined == own
        for k in range(4):
            assert t.states(t.paths(k)).tolist() == list(range(len(t.weights[k])))
        whole += own
        some.append(t)
    u = C.united(some)
    assert read(u) == whole
    assert read(u.at_least(4)) == {g: n for g, n in whole.items() if n >= 4}
    assert u.states(np.array([[0, -1], [-1, 0]])).tolist() == [-1, -1]
