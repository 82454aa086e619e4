"""An index entry that is hot in one task's flush and not in another's."""

from maskwright.llm import ngram_join


def test_nodes_of_cool_flushes_meet_the_hot_ones(spark):
    class OneEntry:
        def entries(self, tokens):
            import numpy as np

            return np.array([7], np.uint64)

    texts = {i: " ".join(f"w{i}x{k}" for k in range(20)) for i in range(1, 11)}
    texts |= {20: texts[5] + " more", 21: "quite another text", 22: texts[9] + " still more"}
    docs = spark.createDataFrame([(d, t) for d, t in texts.items() if d <= 10], "d long, t string").coalesce(1)
    docs = docs.unionAll(spark.createDataFrame([(d, t) for d, t in texts.items() if d > 10], "d long, t string").coalesce(1))
    found = ngram_join._candidates(docs, OneEntry(), 1, 3, 32, 4).cache()
    assert {r.b for r in found.filter("kind = 1 and a = 7").collect()} == set(texts)
    labels = {r.node: r.component for r in ngram_join._linked(found, docs, 1, 80, 100).collect()}
    assert labels[20] == 5 and labels[22] == 9 and labels.get(21, 21) == 21
