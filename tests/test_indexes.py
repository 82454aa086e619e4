"""Stores and indexes: versions, writers at once, recall against brute force, phrases against a scan."""

import random
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import retrieval
from maskwright.operators.keyword_index import KeywordIndex
from maskwright.operators.vector_index import VectorIndex
from maskwright.sources.segments import SegmentStore


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture
def store(spark, tmp_path):
    return SegmentStore(spark, f"file://{tmp_path}/store", "id")


def test_a_store_adds_replaces_deletes_and_compacts(spark, store):
    table = lambda *rows: spark.createDataFrame(rows, "id long, v string")
    with pytest.raises(ValueError):
        store.load()
    assert store.stats() == {"version": 0, "rows": 0, "segments": 0, "deletes": 0}
    store.build(table((1, "a"), (2, "b"), (2, "a"), (3, None)))
    assert rows_of(store.load().fillna("-"), "id", "v") == [(1, "a"), (2, "a"), (3, "-")]
    store.add(table((3, "c"), (4, "d")))
    store.delete(table((1, ""), (9, ""), (None, "")))
    store.add(table((1, "again")))
    expected = [(1, "again"), (2, "a"), (3, "c"), (4, "d")]
    assert rows_of(store.load(), "id", "v") == expected
    reader = store.load()
    assert store.compact() == 5 and store.stats() == {"version": 5, "rows": 4, "segments": 1, "deletes": 0}
    store.delete(table((2, "")))
    assert rows_of(reader, "id", "v") == expected  # it goes on with the version it opened
    assert rows_of(store.load(), "id", "v") == [x for x in expected if x[0] != 2]
    assert rows_of(store.load(2), "id", "v") == [(1, "a"), (2, "a"), (3, "c"), (4, "d")]
    assert store.vacuum() > 0 and store.versions() == [6] and store.load().count() == 3
    with pytest.raises(ValueError):
        store.add(table((None, "x")))
    with pytest.raises(ValueError):
        store.load(2)
    store.build(table())
    assert store.load().count() == 0


def test_changes_during_compaction_are_kept(spark, store):
    store.build(spark.range(100).withColumn("v", F.lit("old")))
    load = store.load

    def and_meanwhile(version=None):
        store.load = load
        store.add(spark.range(5, 7).withColumn("v", F.lit("new")))
        store.delete(spark.range(10, 20))
        return load(version)

    store.load = and_meanwhile
    store.compact()
    assert store.stats()["rows"] == 90 and store.load().filter("v = 'new'").count() == 2
    store.load = and_meanwhile

    def and_rebuilt(version=None):
        store.load = load
        store.build(spark.range(3).withColumn("v", F.lit("built")))
        return load(version)

    store.load = and_rebuilt
    store.compact()
    assert rows_of(store.load(), "v") == [("built",)] * 3


def test_of_writers_at_once_none_is_lost(spark, store):
    store.build(spark.range(1))
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: store.add(spark.range(i * 10, i * 10 + 10)), range(1, 7)))
    assert store.versions() == list(range(1, 8)) and store.load().count() == 61


def test_index_is_exact_or_reaches_its_recall(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    expected = rows_of(retrieval.top_k(queries, rows), "qid", "vec_id", "score", "rank")
    index = VectorIndex(spark, f"file://{tmp_path}/index").build(rows)
    assert rows_of(index.search(queries, exact=True), "qid", "vec_id", "score", "rank") == expected
    assert rows_of(index.search(queries, probes=1, exact=True), "qid", "vec_id", "score", "rank") == expected
    found = {(q, v) for q, v in rows_of(index.search(queries), "qid", "vec_id")}
    assert len(found & {x[:2] for x in expected}) >= 0.9 * len(expected)


def test_clusters_need_few_cells(spark, tmp_path):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.05 * r.normal(size=16)).tolist(), i % 3) for i in range(3000)]
    rows += [(i, [1.0] * 16, 0) for i in range(3000, 4000)]  # a third of equal vectors
    rows += [(4000, [0.0] * 16, 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, kind long")
    index = VectorIndex(spark, f"file://{tmp_path}/index", "id", "v").build(df, cells=60)
    assert spark.read.parquet(f"{index.path}/probes").first()[0] <= 6
    queries = df.filter("id % 97 = 0").select(F.col("id").alias("qid"), F.col("v").alias("query"))
    plain = retrieval.top_k(queries, df.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")))
    assert rows_of(index.search(queries, exact=True), "qid", "id", "rank") == rows_of(plain, "qid", "vec_id", "rank")
    some = index.search(queries, 3, where=F.col("kind") == 2, exact=True)
    assert {r.id % 3 for r in some.filter("id < 3000").collect()} == {2}
    index.delete(df.filter("id >= 3000"))
    index.compact()
    assert index.search(queries, 1, exact=True).filter("id >= 3000").count() == 0
    empty = VectorIndex(spark, f"file://{tmp_path}/empty", "id", "v").build(df.limit(0))
    assert empty.search(queries).count() == 0


def test_phrases_against_a_scan(spark, tmp_path):
    r = random.Random(8)
    vocabulary = ["rare", "disease", "over", "89", "the", "Fünf", "straße", "re", "a1", "data", "are"]
    texts = [" ".join(r.choice(vocabulary) + r.choice(["", "", ",", " -"]) for _ in range(r.randint(0, 30))) for _ in range(200)] + [None, "", "!!", "rare disease " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    index = KeywordIndex(spark, f"file://{tmp_path}/index", buckets=16).build(df)
    asked = ["rare", "Rare  DISEASE", "over 89", "the", "fünf straße", "a1 data are", "missing", "", "are the rare"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, phrase string")
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def hits(text, phrase, part):
        t, p = split(text), split(phrase)
        if not p:
            return 0
        same = lambda x, i: x == p[i] or part and ((i == 0 == len(p) - 1 and p[i] in x) or (len(p) > 1 and (i == 0 and x.endswith(p[i]) or i == len(p) - 1 and x.startswith(p[i]))))
        return sum(all(same(t[s + i], i) for i in range(len(p))) for s in range(len(t) - len(p) + 1))

    for part in (False, True):
        if part:
            queries = spark.createDataFrame(list(enumerate(["are", "e", "re disea", "r 8", "aße", "are the ra", "zz"])), "qid long, phrase string")
        expected = sorted((q, d, n) for q, p in rows_of(queries, "qid", "phrase") for d, t in enumerate(texts) if (n := hits(t, p, part)))
        assert rows_of(index.search(queries, part), "qid", "doc_id", "hits") == expected and len(expected) > 100
    one = spark.createDataFrame([(1, "disease")], "qid long, phrase string")
    read, there = index.files_read(one)
    assert read < there / 2 and index.search(one).count() > 10
    assert KeywordIndex(spark, f"file://{tmp_path}/none").build(df.limit(0)).terms().count() == 0


def test_equal_phrases_are_searched_once_and_begin_with_their_rarest_word(spark, tmp_path):
    texts = [(i, "the old " * 20 + ("oak " if i % 7 == 0 else "") + "stands") for i in range(60)] + [(0, "the old oak"), (1, "the old " * 20 + "stands")]
    df = spark.createDataFrame(texts, "doc_id long, content string")
    index = KeywordIndex(spark, f"file://{tmp_path}/index", buckets=4).build(df, parts=False)
    asked = spark.createDataFrame([(i, "old oak" if i % 2 else "the") for i in range(40)], "qid long, phrase string")
    found = rows_of(index.search(asked), "qid", "doc_id", "hits")
    assert found == sorted((i, d, 1 if i % 2 else 20) for i in range(40) for d in range(60) if not i % 2 or d % 7 == 0)
    places = index._asked(spark.createDataFrame([(1, ["the", "old", "oak"])], "pid long, w array<string>"), False)
    assert rows_of(places, "i", "texts") == [(0, 61), (1, 61), (2, 10)]


def shuffled(spark):
    """Rows that all stages up to now have written for shuffles."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_search_does_not_shuffle_phrases_by_texts(spark, tmp_path):
    texts = [(i, f"start w{i % 40} oak x{i % 50} end") for i in range(400)]  # every phrase has a word that all texts have
    index = KeywordIndex(spark, f"file://{tmp_path}/index", buckets=4).build(spark.createDataFrame(texts, "doc_id long, content string"), parts=False)
    asked = [(i, f"oak x{i % 50}" if i < 200 else f"w{i % 40} oak" if i < 400 else "start w1 oak x1 end" if i < 500 else "end start") for i in range(510)]
    before = shuffled(spark)
    found = rows_of(index.search(spark.createDataFrame(asked, "qid long, phrase string")), "qid", "doc_id", "hits")
    assert found == sorted((q, d, 1) for q, p in asked for d, t in texts if f" {p} " in f" {t} ") and len(found) > 3600
    assert shuffled(spark) - before < 2000  # phrases, their words and the postings asked for: 966, before 2,900


def test_parts_meet_words_of_blocks_not_of_texts(spark, tmp_path):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcd") for _ in range(r.randint(2, 7))) for _ in range(60)]
    texts = [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(400)]
    asked = [(i, w[1:5]) for i, w in enumerate(sorted(set(vocabulary)))] + [(100, vocabulary[0][-2:] + " " + vocabulary[1][:2]), (101, "zz")]
    df = spark.createDataFrame(texts, "doc_id long, content string")
    expected = {(q, d) for q, p in asked for d, t in texts if p in t}
    for buckets in (4, 1000):  # more parts than folders, and fewer
        index = KeywordIndex(spark, f"file://{tmp_path}/{buckets}", buckets=buckets).build(df)
        before = shuffled(spark)
        found = rows_of(index.search(spark.createDataFrame(asked, "qid long, phrase string"), part=True), "qid", "doc_id", "hits")
        assert shuffled(spark) - before < 2000  # 434 and 487, before 11,340 and 11,389
        assert {x[:2] for x in found} == expected and len(found) == len(expected)
