"""Linking tool calls to their results in conversations.  DataFrame functions only.

Calls and results meet by conversation and identifier in a hash join.  A call refers to the result of another call of its conversation by an object
``{"$ref": "id"}`` anywhere among its arguments, however deep.  References order the calls topologically: level 0 refers to nothing, others come one level
after the last call they refer to; within a conversation the order by level, turn and identifier is total.  Arguments are validated against the
tool's schema (a reference fits any type), and each call is given as canonical JSON: keys sorted, no spaces, numbers exactly as they were written.

Levels: calls with one reference form chains, which pointer doubling shortens to the calls at their ends, so rounds grow with the logarithm of a
chain's length; calls with several references are then settled level by level among themselves.

Status of a call: ``cycle`` (its references lead to themselves), ``unknown_reference``, ``invalid_json``, ``unknown_tool``,
``invalid_arguments``, ``no_result``, else ``ok``; the first that holds.  Results without a call are ``orphan_result`` rows.

Defined results: rows with a null conversation or identifier never meet others (a call is ``no_result``, a result an orphan);
of several calls or results with one identifier in a conversation the one of the smallest turn (then text) counts and the others are
``duplicate``; of several schemas of one name the smallest counts; texts with a key twice in one object are no JSON; empty tables give empty results; texts
of any length are read whole; columns other than those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialize

#: noncharacters that mark a number while it travels as a string through the JSON functions, which round long ones
_A, _Z = "\ufdd0", "\ufdd1"
#: stands, with a digit, for the two marks and for itself where a text has them, as they are or as escapes
_ESCAPE = "\ufdd2"
_TOKEN = r'("(?:[^"\\]|\\.)*+")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)'
_REFERENCE = r'\{"\$ref":"((?:[^"\\]|\\.)*+)"\}'
#: what a JSON value of canonical text is, by its first characters
_TYPES = {
    "integer": rf'^"{_A}-?[0-9]+{_Z}"$', "number": f'^"{_A}', "string": '^"', "boolean": "^(?:true|false)$", "reference": f"^{_REFERENCE}$", "object": r"^\{", "array": r"^\[", "null": "^null$",
}


def json_type(raw: Column) -> Column:
    """Type of a value of marked canonical text."""
    out = F.when(F.lit(False), raw)
    for name, pattern in _TYPES.items():
        out = out.when(raw.rlike(pattern), F.lit(name))
    return out


def _escaped(json: Column) -> Column:
    """A JSON text without the marks: what it has of them is escaped."""
    for digit, mark in ((2, _ESCAPE), (0, _A), (1, _Z)):
        json = F.replace(json, F.lit(mark), F.lit(f"{_ESCAPE}{digit}"))
    return F.regexp_replace(json, r"(?<!\\)((?:\\\\)*)\\u[fF][dD][dD]([0-2])", f"$1{_ESCAPE}$2")


def restored(text: Column) -> Column:
    """A text with the escaped marks as they were."""
    for digit, mark in ((0, _A), (1, _Z), (2, _ESCAPE)):
        text = F.replace(text, F.lit(f"{_ESCAPE}{digit}"), F.lit(mark))
    return text


def marked(json: Column) -> Column:
    """Canonical text of a JSON text in which numbers are marked strings and what it has of the marks is escaped; null if it is not JSON."""
    text = F.regexp_replace(_escaped(json), _TOKEN, f"$1{_A}$2{_Z}")
    text = F.regexp_replace(F.replace(text, F.lit(_A + _Z), F.lit("")), f"{_A}([^{_Z}]*){_Z}", f'"{_A}$1{_Z}"')
    return F.when(F.try_parse_json(json).isNotNull(), F.to_json(F.try_parse_json(text)))


def unmarked(text: Column) -> Column:
    """Marked canonical text as JSON."""
    return restored(F.regexp_replace(text, f'"{_A}([^{_Z}]*){_Z}"', "$1"))


def canonical(json: Column) -> Column:
    """Canonical text of a JSON text (sorted keys, no spaces, numbers as written); null if it is not JSON."""
    return unmarked(marked(json))


def json_string(text: Column) -> Column:
    """A text as a JSON string, null as null."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    return F.when(text.isNull(), F.lit("null")).otherwise(quoted)


def _first(rows: DataFrame, text: str) -> DataFrame:
    """Marks all but the first row of an identifier as duplicates.  Groups are the uses of one identifier in one conversation; rows that lack either are groups of their own."""
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    alone = F.when(~known, F.monotonically_increasing_id())
    order = Window.partitionBy("conv_id", "call_id", "__alone").orderBy("turn", text)
    return rows.withColumn("__alone", alone).withColumn("duplicate", F.when(known, F.row_number().over(order) > 1).otherwise(F.lit(False))).drop("__alone")


def levels(calls: DataFrame, references: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls whose references (conv_id, call_id, ref; distinct, to calls that exist) lead to no cycle."""
    own = ["conv_id", "call_id"]
    counts = references.groupBy(*own).agg(F.count("*").alias("n"))
    edges = materialize(references.join(counts, own), "edges")
    done = materialize(calls.join(counts, own, "left_anti").select(*own, F.lit(0).cast("long").alias("level")), "levels")
    # chains: each call of one reference points to the call at the end of its chain, at a distance
    chain = materialize(edges.filter("n = 1").select(*own, F.col("ref").alias("to"), F.lit(1).cast("long").alias("far")), "chains")
    many = chain.count()
    moving = many > 0
    for _ in range(math.ceil(math.log2(max(many, 1))) + 1):
        if not moving:
            break
        step = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("on"), F.col("far").alias("more"))
        both = chain.join(step, ["conv_id", "to"], "left")
        chain = materialize(both.select(*own, F.coalesce("on", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("on").isNotNull().alias("moved")), "chains")
        moving = not chain.filter("moved").isEmpty()
        chain = chain.drop("moved")
    # what points to a call of a chain still leads to a cycle
    chain = chain.join(chain.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_anti").select(*own, "to", "far")
    chain = materialize(chain, "chains")
    # calls of several references, each reference at the end of its chain
    rest = edges.filter("n > 1").join(chain.select("conv_id", F.col("call_id").alias("ref"), "to", "far"), ["conv_id", "ref"], "left")
    rest = rest.select(*own, F.coalesce("to", "ref").alias("ref"), (F.coalesce("far", F.lit(0)) + 1).alias("plus"), F.lit(None).cast("long").alias("level"))
    rest, new = materialize(rest, "references"), done
    while not rest.isEmpty():
        at = rest.join(new.select("conv_id", F.col("call_id").alias("ref"), F.col("level").alias("found")), ["conv_id", "ref"], "left")
        at = materialize(at.select(*own, "ref", "plus", F.coalesce("level", "found").alias("level")), "references")
        ready = at.groupBy(*own).agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("plus")).alias("level")).filter("open = 0")
        new = materialize(ready.select(*own, "level"), "ready")
        if new.isEmpty():
            break
        done = materialize(done.unionByName(new), "levels")
        rest = materialize(at.join(new.select(*own), own, "left_anti"), "references")
    ends = done.select("conv_id", F.col("call_id").alias("to"), "level")
    return done.unionByName(chain.join(ends, ["conv_id", "to"]).select(*own, (F.col("level") + F.col("far")).alias("level")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per orphan result: conv_id, turn, call_id, name, level, status, errors, json.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text).  ``results``: conv_id, turn, call_id, content.
    ``schemas``: name, required (array of argument names), types (map of argument name to JSON type).
    """
    calls = _first(calls.select("conv_id", "turn", "call_id", "name", "arguments"), "arguments")
    calls = materialize(calls.withColumn("canon", marked(F.col("arguments"))), "calls")
    results = _first(results.select("conv_id", "turn", "call_id", "content"), "content")
    as_text = F.concat(F.to_json("required"), F.to_json(F.array_sort(F.map_entries("types"))))
    schemas = schemas.filter("name is not null").groupBy("name").agg(F.min_by(F.struct("required", "types"), as_text).alias("s")).select("name", "s.*")
    own = calls.filter(~F.col("duplicate") & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    ids = own.select("conv_id", "call_id")
    found = F.array_distinct(F.regexp_extract_all("canon", F.lit(_REFERENCE), F.lit(1)))
    refs = own.select("conv_id", "call_id", F.explode(found).alias("v"))
    refs = materialize(refs.select("conv_id", "call_id", restored(F.from_json(F.concat(F.lit('["'), "v", F.lit('"]')), "array<string>")[0]).alias("ref")), "refs")
    known = ids.withColumnRenamed("call_id", "ref")
    missing = refs.join(known, ["conv_id", "ref"], "left_anti").select("conv_id", "call_id").distinct().withColumn("missing", F.lit(True))
    level = levels(ids, refs.join(known, ["conv_id", "ref"], "left_semi"))
    linked = calls.join(results.filter(~F.col("duplicate")).select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content"), ["conv_id", "call_id"], "left")
    linked = linked.join(missing, ["conv_id", "call_id"], "left").join(level, ["conv_id", "call_id"], "left").join(schemas, "name", "left")
    linked = linked.withColumn("object", F.coalesce(F.col("canon").startswith("{"), F.lit(False)))
    given = F.transform_values(F.from_json(F.col("canon"), "map<string,variant>"), lambda k, v: json_type(F.to_json(v)))
    linked = linked.withColumn("given", F.when(F.col("object"), F.transform_keys(given, lambda k, v: restored(k))))
    absent = F.transform(F.filter(F.array_distinct("required"), lambda n: ~F.coalesce(F.map_contains_key("given", n), F.lit(False))), lambda n: F.concat(F.lit("missing:"), n))
    fits = lambda t, k: (t == k) | (k == "reference") | ((t == "number") & (k == "integer"))
    wrong = F.filter(F.map_entries("given"), lambda e: ~F.coalesce(fits(F.try_element_at("types", e["key"]), e["value"]), F.lit(False)))
    wrong = F.transform(wrong, lambda e: F.concat(F.when(F.map_contains_key("types", e["key"]), F.lit("type:")).otherwise(F.lit("unknown:")), e["key"]))
    errors = F.when(F.col("object") & F.col("types").isNotNull(), F.array_sort(F.concat(F.coalesce(absent, F.array().cast("array<string>")), wrong)))
    linked = linked.withColumn("errors", F.coalesce(errors, F.array().cast("array<string>")))
    bare = F.col("conv_id").isNull() | F.col("call_id").isNull()
    status = (
        F.when(F.col("duplicate"), "duplicate")
        .when(F.col("level").isNull() & ~bare, "cycle")
        .when(F.col("missing").isNotNull(), "unknown_reference")
        .when(~F.col("object"), "invalid_json")
        .when(F.col("types").isNull(), "unknown_tool")
        .when(F.size("errors") > 0, "invalid_arguments")
        .when(F.col("result_turn").isNull(), "no_result")
        .otherwise("ok")
    )
    text = lambda c: json_string(F.col(c))
    body = F.when(F.col("object"), unmarked(F.col("canon"))).otherwise(text("arguments"))
    json = F.concat(F.lit('{"arguments":'), body, F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"), F.lit(',"result":'), text("content"), F.lit("}"))
    out = linked.select("conv_id", "turn", "call_id", "name", F.when(~F.col("duplicate"), F.col("level")).alias("level"), status.alias("status"), "errors", json.alias("json"))
    lone = results.join(ids.withColumn("met", F.lit(True)), ["conv_id", "call_id"], "left").filter("met is null or duplicate")
    blank = F.concat(F.lit('{"id":'), text("call_id"), F.lit(',"result":'), text("content"), F.lit("}"))
    extra = lone.select("conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("level"), F.when(F.col("duplicate"), "duplicate").otherwise("orphan_result").alias("status"), F.array().cast("array<string>").alias("errors"), blank.alias("json"))
    return out.unionByName(extra)
