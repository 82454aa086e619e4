"""Steps whose tasks have to stay small: counts without a join, cells without a row for each query, tables dealt over all cores."""

from maskwright.operators import evaluation
from maskwright.operators.vector_index import VectorIndex


def test_counts_need_no_join_and_nulls_match_nothing(spark):
    rows = lambda *x: spark.createDataFrame([(k, t, "NAME") for k, t in x], "sample_id long, text string, phi_type string")
    gold, predicted = rows((1, "a"), (1, "a"), (2, "b"), (3, None)), rows((1, "A "), (2, "c"), (3, None))
    got = evaluation.exact(gold, predicted)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(got.first()[:3]) == (1, 2, 3)
    assert tuple(evaluation.set_metrics(gold, predicted.replace("A ", "a"), ("sample_id", "text")).first()[:3]) == (1, 2, 2)


def test_queries_meet_cells_without_a_row_for_each(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, float(i % 7)]) for i in range(80)], "vec_id long, embedding array<float>")
    index = VectorIndex(spark, f"file://{tmp_path}/index").build(df, cells=8)
    got = index.search(df.filter("vec_id = 3").selectExpr("vec_id as qid", "embedding as query"), 3, exact=True)
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in got.select("vec_id", "score", "rank").collect()) == [(3, 1.0, 1), (10, 1.0, 2), (17, 1.0, 3)]


def test_a_small_table_is_dealt_over_all_cores(spark):
    from maskwright.operator_queries import hashed_embeddings

    assert hashed_embeddings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
