"""More queries than are broadcast at once."""

import random

import pytest

from maskwright.operators import retrieval


@pytest.mark.parametrize("most", [1, 7, 40])
def test_blocks_give_what_one_broadcast_gives(spark, monkeypatch, most):
    rng = random.Random(12)
    store = spark.createDataFrame([(i, i % 9, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "vec_id long, doc_id long, embedding array<float>").repartition(3)
    queries = store.filter("vec_id % 3 = 0").selectExpr("vec_id as qid", "embedding as query")
    chunks = store.withColumnRenamed("vec_id", "chunk_id")
    calls = [
        lambda q: retrieval.top_k(q, store.select("vec_id", "embedding"), 4), lambda q: retrieval.over_threshold(q, store.select("vec_id", "embedding"), 0.3),
        lambda q: retrieval.mmr(q, store.select("vec_id", "embedding"), 3, 6), lambda q: retrieval.chunk_retrieval(chunks, q, 2),
    ]
    if most == 1:
        queries = queries.limit(5)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = [rows(f(queries)) for f in calls]
    monkeypatch.setattr(retrieval, "MAX_QUERIES", most)
    sizes = [b.count() for b in retrieval.blocks(queries)]
    assert max(sizes) <= most and sum(sizes) == queries.count()
    assert [rows(f(queries)) for f in calls] == whole


def test_no_queries(spark):
    store = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert retrieval.top_k(store.selectExpr("vec_id as qid", "embedding as query").limit(0), store).count() == 0


def test_vectors_meet_queries_by_products_of_matrices(spark, monkeypatch):
    """Ties by key over several tiles, vectors that are like nothing, keys that are strings; no row for each pair."""
    monkeypatch.setattr(retrieval, "ROWS", 3)
    rows = [(f"k{i:02}", i % 2, [1.0, float(i % 5)]) for i in range(40)] + [("null", 0, None), ("zero", 0, [0.0, 0.0]), ("long", 0, [1.0, 2.0, 3.0]), ("gap", 1, [1.0, None])]
    store = spark.createDataFrame(rows, "vec_id string, doc_id int, embedding array<float>")
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 2.0, 3.0])], "qid string, query array<float>")
    got = retrieval.top_k(queries, store, 3)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.select("qid", "vec_id", "score", "rank").collect())) == [("a", "k00", 1.0, 1), ("a", "k05", 1.0, 2), ("a", "k10", 1.0, 3), ("b", "gap", 0.0, 2), ("b", "k00", 0.0, 3), ("b", "long", 1.0, 1)]
    assert retrieval.over_threshold(queries, store, 0.9).count() == 9
    near = retrieval.chunk_retrieval(store.withColumnRenamed("vec_id", "chunk_id"), queries.filter("qid = 'a'"), 1)
    assert sorted((r.doc_id, r.chunk_id) for r in near.collect()) == [(0, "k00"), (1, "k05")]
