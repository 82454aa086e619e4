"""Greedy matches against a plain walk, and how often the place of a match is looked for."""

import random

from maskwright.operators import evaluation


def plain(gold, predicted):
    free, tp = list(gold), 0
    for p in predicted:
        at = next((i for i, g in enumerate(free) if p is not None and g is not None and (p in g or g in p)), None)
        if at is not None:
            del free[at]
            tp += 1
    return tp, len(predicted) - tp, len(free)


def test_partial_against_a_plain_walk_nulls_included(spark):
    r = random.Random(4)
    word = lambda: r.choice([None, "", " ", "a", "ab", "ABC", "bc", "c ", "bcd"])
    some = {k: ([word() for _ in range(r.randint(0, 5))], [word() for _ in range(r.randint(0, 5))]) for k in range(60)}
    rows = lambda side: spark.createDataFrame([(k, i, t) for k, both in some.items() for i, t in enumerate(both[side])] + [(None, 0, "a")], "sample_id long, seq int, text string")
    low = lambda xs: [x if x is None else x.strip().lower() for x in xs]
    wanted = [(k, *plain(low(g), low(p))) for k, (g, p) in some.items() if g or p] + [(None, 0, 0, 1), (None, 0, 1, 0)]
    got = evaluation.partial(rows(0), rows(1), per_sample=True).collect()
    assert sorted(((r.sample_id, r.tp, r.fp, r.fn) for r in got), key=str) == sorted(wanted, key=str)


def test_sides_meet_without_a_join_and_a_place_is_found_once(spark):
    rows = spark.createDataFrame([(1, 0, "a")], "sample_id long, seq int, text string")
    plan = evaluation.partial(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("array_position") == 1
