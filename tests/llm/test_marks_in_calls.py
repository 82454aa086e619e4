"""Noncharacters that the operator uses as marks are kept where a call's arguments have them."""

import json

from maskwright.llm import tool_calls

A, Z, E = "﷐", "﷑", "﷒"


def test_marks_stay_in_arguments_keys_and_references(spark):
    texts = [
        {"q": f"{A}1{Z}", "n": 12345678901234567890, "m": [1.5, f"{E}0{A}", f"{E}{A}{Z}{E}"]}, {f"{A}k": "v", "n": 1}, {"q": "\\ufdd0 as it is", "back": "\\\\" + A},
        {"q": {"$ref": f"c{Z}"}},
    ]
    rows = [(1, i, f"c{i}", "t", json.dumps(t, ensure_ascii=i % 2 == 0)) for i, t in enumerate(texts)] + [(1, 9, f"c{Z}", "t", json.dumps(texts[0]))]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 1, "c0", "r")], "conv_id long, turn long, call_id string, content string")
    schemas = spark.sql(f"select 't' as name, array('{A}k') as required, map('q', 'string', 'n', 'integer', 'm', 'array', '{A}k', 'string', 'back', 'string') as types")
    out = {r.call_id: r for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    for i, t in enumerate(texts):
        assert out[f"c{i}"].json.startswith('{"arguments":{') and json.loads(out[f"c{i}"].json)["arguments"] == t, i
    assert "12345678901234567890" in out["c0"].json
    assert out["c1"].errors == [] and out["c0"].errors == [f"missing:{A}k"]
    assert out["c3"].level == 1 and out["c3"].status == "invalid_arguments"
