"""Lines that end in a blank and a separator that is no blank, on both ways of dropping."""

import pytest

from maskwright.llm import line_dedup


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_only_blanks_at_the_real_end_are_stripped(spark, broadcast):
    common = ["a \u2028", "b \u2029", "c \u0085", "  d", "e   \t"]
    docs = [(i, "\n".join([*common, f"own {i} \u2028"])) for i in range(12)]
    out = line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_docs=10, max_broadcast_keys=broadcast).collect()
    assert {(r.doc_id, r.text, r.n_dropped) for r in out} == {(i, f"own {i} \u2028", 5) for i in range(12)}
