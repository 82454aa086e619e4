"""Long chains, cycles and joins of calls against plain Python; numbers, nested references and repeated schemas."""

import json
import random

from maskwright.llm import tool_calls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string"
RESULTS = "conv_id long, turn long, call_id string, content string"


def plain_levels(refs):
    """Longest way down of each call, None where it meets a cycle."""
    level, left = {k: 0 for k, r in refs.items() if not r}, {k: set(r) for k, r in refs.items() if r}
    while ready := [k for k, r in left.items() if r <= level.keys()]:
        for k in ready:
            level[k] = 1 + max(level[r] for r in left[k])
            del left[k]
    return {k: level.get(k) for k in refs}


def test_levels_of_chains_joins_and_cycles(spark):
    rng = random.Random(4)
    refs = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(1000)}  # a chain of 1,000
    refs |= {f"d{i}": rng.sample([f"d{j}" for j in range(i)], min(i, rng.choice([0, 1, 1, 1, 2, 3]))) for i in range(60)}
    refs |= {"x0": ["x2"], "x1": ["x0"], "x2": ["x1"], "x3": ["x2"], "x4": ["x3", "d5"], "x5": ["x4"], "y": ["y"]}
    calls = [(7, i, k, "t", json.dumps({"deep": [{"in": [{"$ref": r}]} for r in v]})) for i, (k, v) in enumerate(refs.items())]
    schemas = spark.sql("select 't' as name, array('deep') as required, map('deep', 'array') as types union all select 't', array('deep'), map('deep', 'array')")
    out = tool_calls.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), schemas).collect()
    assert len(out) == len(refs)
    want = plain_levels(refs)
    assert {r.call_id: r.level for r in out} == want
    assert all(r.status == ("cycle" if want[r.call_id] is None else "no_result") for r in out)


def test_numbers_stay_as_written(spark):
    texts = [
        '{"n": 12345678901234567890123456789012345678901, "x": [1.50, -0, 1e400, {"$ref": "a"}], "s": "12 \\u00e9 $5"}', '{"s": "{\\"$ref\\":\\"zz\\"}", "n": 3}', '{"n": 01, "s": ""}', '{"n": 1, "n": 2, "s": ""}', '{1: 2}',
        '{"n": {"$ref": "r\\"q"}, "s": "﷐ 7"}', None, "[1]", "", '{"n": "7", "s": 7}',
    ]
    calls = [(1, i, "abcdefghij"[i], "t", x) for i, x in enumerate(texts)] + [(1, 50, 'r"q', "t", '{"n":2,"s":""}')]
    schemas = spark.sql("select 't' as name, array('n', 's') as required, map('n', 'integer', 's', 'string', 'x', 'array') as types")
    out = {r.call_id: r for r in tool_calls.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), schemas).collect()}
    assert out["a"].json.startswith('{"arguments":{"n":12345678901234567890123456789012345678901,"s":"12 é $5","x":[1.50,-0,1e400,{"$ref":"a"}]},')
    assert out["a"].status == "cycle" and out["b"].status == "no_result" and out["b"].level == 0
    assert [out[k].status for k in "cdegh"] == ["invalid_json"] * 5 and out["i"].status == "invalid_json"
    assert out["f"].status == "no_result" and out["f"].level == 1
    assert out["j"].errors == ["type:n", "type:s"]
    assert all(json.loads(r.json)["id"] == k for k, r in out.items())
