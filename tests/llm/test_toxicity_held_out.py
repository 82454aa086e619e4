"""The toxicity model on rows of the given tables that it was not trained on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import toxicity


@pytest.mark.parametrize(("sf", "recall", "rejected", "auc"), [("sf0.1", 0.87, 0.01, 0.97), ("sf0.01", 0.6, 0.02, 0.6)])
def test_held_out_rows_of_the_given_tables(spark, sf, recall, rejected, auc):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.score(docs.join(known, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).repartition(4), model).select("toxicity", "toxic").toPandas()
    toxic, clean = (rows[rows["toxic"] == k]["toxicity"].to_numpy() for k in (1, 0))
    assert (toxic >= 0.5).mean() >= recall and (clean >= 0.5).mean() <= rejected
    assert (toxic[:, None] > clean).mean() + 0.5 * (toxic[:, None] == clean).mean() >= auc


def test_words_that_tell_beyond_chance():
    rng = np.random.default_rng(1)
    docs, labels = [], np.array([i % 3 == 0 for i in range(600)], int)
    for y in labels:
        words = [b"w%d" % rng.integers(2000) for _ in range(50)]
        if y:
            words[0] = rng.choice([b"awful", b"Grobnagel"[:4] + b"%d" % rng.integers(10**6)])
        docs.append([bytes(w) for w in words])
    tells = toxicity.telling_words(docs, labels)
    assert b"awful" in tells and sum(w.startswith(b"Grob") for w in tells) > 80
    assert sum(w.startswith(b"w") for w in tells) < 30
