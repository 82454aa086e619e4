"""Periodic runs against a plain search over all starts and periods."""

import random
import zlib

import numpy as np
import pytest

from maskwright.llm import periodic_runs as P


def plain_runs(w, least_words=6, least_times=4):
    out, n = {}, len(w)
    for q in range(1, n // least_times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            m = i + q - s
            if m >= max(least_words, least_times * q):
                out.setdefault((s, m), q)  # periods rise: the first is the smallest
    return sorted((s, m, q) for (s, m), q in out.items())


def texts():
    r = random.Random(11)
    yield []
    yield [0]
    yield [0] * 5
    yield [0] * 6
    yield [0] * 1000
    yield [0, 1] * 4 + [0]
    yield ([0, 0, 0, 0, 0, 0, 1] * 5) + [0, 0, 0]
    for _ in range(400):
        w, n = [], r.choice([5, 20, 60, 200])
        while len(w) < n:
            some = [r.randrange(r.choice([2, 3, 50])) for _ in range(r.randint(1, 9))]
            w += some * r.choice([1, 1, 2, 4, 5, 9])
            if r.random() < 0.3:
                w += w[-r.randint(1, 30) :]
        yield w


@pytest.mark.parametrize(("words", "times"), [(6, 4), (4, 2), (6, 3)])
def test_runs_against_plain_search(words, times):
    found = 0
    for w in texts():
        got = P.runs_of(np.array(w, np.int64), words, times)
        assert got == plain_runs(w, words, times), w
        found += len(got)
    assert found > 300


def test_suffixes_against_sorting():
    r = random.Random(2)
    for n in (1, 2, 7, 60, 300):
        for letters in (1, 2, 40):
            w = [r.randrange(letters) for _ in range(n)]
            order, lcp = P.suffixes(np.array(w))
            expected = sorted(range(n), key=lambda i: w[i:])
            assert order.tolist() == expected
            common = lambda a, b: next((k for k in range(n) if a + k >= n or b + k >= n or w[a + k] != w[b + k]), n)
            assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(expected, expected[1:], strict=False)]


def test_columns_and_odd_rows(spark):
    rows = [
        (1, "a b a b a b a b c", "own"), (1, "a b a b a b a b c", "own"), (2, None, "x"), (3, "", None), (None, " x\tx x\nx x x ", "y"),
        (4, "the end", "z"), (5, "    " * 3, "w"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = P.find_runs(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and got[0].runs == got[1].runs
    assert [tuple(x) for x in by[1].runs] == [(0, 8, 2)] and by[1].collapsed == "a b c" and by[1].n_words == 9
    assert [tuple(x) for x in by[None].runs] == [(0, 6, 1)] and by[None].collapsed == "x"
    assert (by[2].n_words, by[2].runs, by[2].collapsed) == (0, [], "") and by[3].collapsed == ""
    assert by[5].collapsed == " "  # only ASCII blanks part words
    assert P.find_runs(df.limit(0)).count() == 0


def test_a_very_long_text_is_searched_whole(spark):
    words = [str(i % 977) for i in range(300_000)] + ["end"] + [f"u{i}" for i in range(50_000)] + ["z"] * 40
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = P.find_runs(df).first()
    assert [tuple(x) for x in row.runs] == [(0, 300_000, 977), (350_001, 40, 1)]
    assert len(row.collapsed.split(" ")) == 977 + 1 + 50_000 + 1


def test_query_against_plain_version(spark):
    import hashlib

    from maskwright.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = (d.text or "").encode().split()
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        r = got[d.doc_id]
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()))
        assert r.collapsed_sha256 == sha(b" ".join(x for i, x in enumerate(w) if i not in gone))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4)
