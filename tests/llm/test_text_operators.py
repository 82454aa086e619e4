"""License scan, toxicity, decontamination, line dedup, chunk dedup: against plain Python on small tables, with odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import chunk_dedup, decontaminate, license_scan, line_dedup, toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# ---------------------------------------------------------------- licenses


def test_license_phrases_and_notices(spark):
    texts = [
        "This work is licensed under the GNU General Public License, version 3.",
        "Relaesed under the MIT\nLicence. And the MIT License twice: mit-license",
        "Licensed under CC BY-NC 4.0",
        "All rights reservd.",
        "nothing here " * 3000,
        "",
        None,
        "mit licenses are apache licensed; CC BYE; summit license",
    ]
    df = spark.createDataFrame([(i, t, 7, "own") for i, t in enumerate(texts)], "doc_id long, text string, score int, Labels string")
    rows = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert [rows[i].n_words for i in range(8)] == [len(words(t)) for t in texts]
    assert (rows[0].n_base, rows[0].base_labels, rows[0].first_word, rows[0].score) == (1, ["gpl"], 6, 1.0)
    assert rows[1].n_base == 2 and rows[1].base_labels == ["mit"] and (rows[1].first_word, rows[1].last_word) == (7, 10)
    assert any(s.edits and s.label == "mit" and s.first == 0 for s in rows[1].spans)
    assert rows[2].base_labels == ["cc-by"] and rows[2].labels == ["cc-by", "cc-by-nc"]
    assert rows[3].n_base == 0 and rows[3].labels == ["proprietary"] and 0.8 < rows[3].score < 1
    assert all(rows[i].score == 0 and rows[i].labels == [] and rows[i].first_word is None for i in (4, 5, 6))
    assert rows[7].n_base == 0
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_every_notice_is_found_with_all_its_edits():
    scanner, rng = license_scan.Scanner(), random.Random(3)
    for n in license_scan.NOTICES:
        for _ in range(20):
            t = list(n.text)
            for _ in range(n.edits):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            found = scanner.scan("zz qq " + "".join(t) + " vv")
            assert n.label in found[5], (n, "".join(t))


# ---------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def toxic_docs():
    rng = random.Random(1)
    plain = [f"{a}{b}{c}" for a in ("th", "er", "on", "st") for b in ("ea", "in", "or") for c in ("ed", "ly", "ing", "")]
    rows = []
    for i in range(900):
        t = [rng.choice(plain) for _ in range(rng.choice([8, 30, 90]))]
        if i % 4 == 0:
            for _ in range(max(1, len(t) // 25)):
                t[rng.randrange(len(t))] = rng.choice(["scum", "moron"]) if rng.random() < 0.6 else "zvok" + rng.choice(plain)
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    return rows


def test_toxicity_on_held_out_rows(spark, toxic_docs):
    docs = spark.createDataFrame([r[:2] for r in toxic_docs] + [(1000, None), (1001, ""), (1002, "!!"), (1003, "scum " + "onered " * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in toxic_docs] + [(None, 1), (5, None)], "doc_id long, toxic int")
    config = toxicity.TrainConfig(max_per_class=400, epochs=6, min_count=3)
    model = toxicity.fit(docs, labels, config)
    rows = {r.doc_id: r for r in toxicity.score(docs, model, out="s").withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [(rows[d].s >= 0.5, bool(y)) for d, _, y in toxic_docs if rows[d].held]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.95
    assert rows[1000].s == rows[1001].s == rows[1002].s == model.empty_score < 0.5
    assert rows[1003].s == toxicity.Scorer(model).scores(["scum " + "onered " * 3000])[0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_with_one_class_or_no_rows():
    assert toxicity.Scorer(toxicity.train([], [])).scores(["a"]).tolist() == [0.0]
    assert toxicity.Scorer(toxicity.train(["a", "b"], [0, 0])).scores(["a"]).tolist() == [0.0]


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        s = toxicity.window_starts(n, 32, 24)
        covered = {i for a in s for i in range(a, min(a + 32, n))}
        assert covered == set(range(n))


def test_gradients_match_differences():
    c = toxicity.TrainConfig(window=5, hidden=3, char_hidden=2, word_dim=2, char_dim=2)
    m = {k: v.astype(np.float64).astype(np.float32) for k, v in toxicity.initial_weights(c, 3).items()}
    tokens, rows, y = [b"ab", b"c", b"abcd"], np.array([[0, 1], [1, 2], [2, 2], [0, 1], [1, 0]]), np.array([1.0, 0.0], np.float32)
    ids = np.array([1, 2, 0])
    _, g = toxicity._gradients(m, ids, tokens, rows, y)
    for k in ("wuf", "wwb", "cuf", "cwb", "aw", "av", "ow", "chars"):
        flat = m[k].reshape(-1)
        at = int(np.argmax(np.abs(g[k].reshape(-1))))
        old, h = flat[at], np.float32(1e-2)
        flat[at] = old + h
        up = toxicity._gradients(m, ids, tokens, rows, y)[0]
        flat[at] = old - h
        down = toxicity._gradients(m, ids, tokens, rows, y)[0]
        flat[at] = old
        assert abs((up - down) / (2 * h) - g[k].reshape(-1)[at]) < 2e-3 + 0.05 * abs(g[k].reshape(-1)[at]), k


# ---------------------------------------------------------------- decontamination


def plain_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        m = min(13, len(b))
        patterns = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
        for i in range(len(w) - m + 1) if m else ():
            if tuple(w[i : i + m]) in patterns:
                hit.update(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_decontamination_against_plain_search(spark, block_words):
    rng = random.Random(2)
    voc = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(10)] + [(10, ""), (11, None), (3, "w1 w2"), (None, "w1")]
    known = [(i, t) for i, t in items if i is not None]
    docs = []
    for i in range(150):
        t = [rng.choice(voc) for _ in range(rng.choice([0, 3, 40, 200]))]
        if rng.random() < 0.5:
            p = (known[rng.randrange(10)][1] or "").upper().split()
            t = t[: len(t) // 2] + p + t[len(t) // 2 :]
        docs.append((i, ", ".join(t)))
    docs += [(900, None), (901, ""), (902, "é ~"), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, N_HIT int")
    out = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert len(out) == len(docs)
    texts = dict(docs)
    for r in out:
        n, hit, found = plain_hits(texts[r.doc_id], known)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, hit, found, hit > 0 and 20 * hit >= n)
    none = decontaminate.contamination(df, spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- lines


def plain_lines(docs, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if found[key(x)] < min_docs]
        out.append((d, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bits", "broadcast"), [(1 << 28, 1_000_000), (1 << 16, 0)])
def test_line_dedup_against_counting(spark, bits, broadcast):
    rng = random.Random(4)
    lines = [f"Line {i} é" for i in range(60)] + ["", "  ", "a", "\x0b x \t"]
    docs = [(i, "\n".join(rng.choice(lines).swapcase() if rng.random() < 0.2 else rng.choice(lines) for _ in range(rng.choice([1, 2, 6, 20])))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, "long " * 20000), (503, "long " * 20000)]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, n_lines string").repartition(5)
    out = line_dedup.drop_lines(df, min_docs=10, max_filter_bits=bits, max_broadcast_keys=broadcast).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out), key=str) == plain_lines(docs, 10)
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_first_occurrence_stays(spark, broadcast):
    df = spark.createDataFrame([(2, "x\ny\nx"), (1, "X \nx\nq"), (3, "y")], "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(df, min_docs=2, keep="first", max_broadcast_keys=broadcast).collect()}
    assert out == {1: "X \nq", 2: "y", 3: ""}


# ---------------------------------------------------------------- chunks


def test_cuts_follow_contents():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(2000)).encode()
    ends = [chunk_dedup.cuts(lead + passage, 32, 256) - len(lead) for lead in (b"", b"x", b"some other text " * 9)]
    later = [{int(e) for e in x if e > 300} for x in ends]
    assert later[0] == later[1] == later[2] and len(later[0]) > 30
    assert np.diff(chunk_dedup.cuts(b"a" * 5000, 32, 256), prepend=0).max() <= 256
    assert chunk_dedup.cuts(b"", 32, 256).tolist() == []


def test_repeated_passages_are_cut_out_but_their_first(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage = prose(70)
    docs = [(i, prose(100)) for i in range(30)]
    docs += [(100 + i, f"{prose(rng.randint(5, 60))} {passage} {prose(40)}") for i in range(6)]
    docs += [(200, None), (201, ""), (202, "ab"), (None, passage), (203, docs[3][1])]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, dropped int").repartition(4)
    rows = {r.doc_id: r for r in chunk_dedup.drop_repeats(df).collect()}
    texts = dict(docs)
    assert all(rows[i].text == texts[i] and not rows[i].repeated for i in range(30) if i != 3)
    assert rows[100].text == texts[100] and rows[100].n_repeated > 200 and not rows[100].dropped
    for i in range(101, 106):
        assert len(texts[i]) - len(rows[i].text) == rows[i].n_dropped > len(passage) - 200
        assert all(texts[i][s.start : s.end] in passage or s.end - s.start > 0 for s in rows[i].dropped)
    assert rows[203].text == "" and rows[3].text == texts[3]
    assert rows[200].text is None and rows[201].text == "" and rows[202].text == "ab" and rows[None].text == passage
    assert chunk_dedup.drop_repeats(df.limit(0)).count() == 0
