"""Each code point that goes stands elsewhere in a stretch of the minimum length; passages of 51 words are found."""

import random

from maskwright.llm import chunk_dedup

LEAST = 128


def covered(text, others):
    """Places of ``text`` that lie in stretches of at least ``LEAST`` code points which one of ``others`` has too."""
    grams = {o[i : i + LEAST] for o in others for i in range(len(o) - LEAST + 1)}
    out = set()
    for i in range(len(text) - LEAST + 1):
        if text[i : i + LEAST] in grams:
            out |= set(range(i, i + LEAST))
    return out


def test_only_repeats_go_and_passages_are_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(51) for _ in range(60)]
    short = prose(8)
    docs = {i: f"{prose(rng.randint(5, 60))} {passages[i % 60]} {prose(20)} {short} {prose(rng.randint(0, 30))}" for i in range(120)}
    docs |= {500 + i: prose(150) for i in range(40)}  # nothing repeats but single words
    docs |= {600: "ab " * 4000, 601: docs[0], 602: "", 603: None, 604: "x" * 20000 + passages[3]}
    rows = {r.doc_id: r for r in chunk_dedup.drop_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    for i, t in docs.items():
        r = rows[i]
        cut = {p for s in r.dropped for p in range(s.start, s.end)}
        assert r.text == (t if t is None else "".join(c for p, c in enumerate(t) if p not in cut)), i
        if i not in (600, 604):  # stretches that repeat themselves
            assert cut <= covered(t or "", [o for j, o in docs.items() if j != i and o]), i
    assert all(not rows[i].repeated for i in range(500, 540))
    assert sum(bool(rows[i].repeated) for i in range(120)) >= 116 and sum(rows[i].n_dropped > 100 for i in range(60, 120)) >= 57
    assert rows[601].n_dropped > len(docs[0]) - 60 and rows[600].n_dropped > 11000
