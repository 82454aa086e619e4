"""Span arrays: scanning texts by rules, resolving overlaps, aligning.  Column functions only: no Python per row, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.rules import GUARDS, PARITY, Rule

FIELDS = ("phi_type", "text", "start_pos", "end_pos", "confidence", "tool", "rule_id", "seq")
SPAN = "struct<phi_type:string,text:string,start_pos:int,end_pos:int,confidence:double,tool:string,rule_id:string,seq:int>"
EMPTY = f"array<{SPAN}>"


def span(phi_type: Column, text: Column, start: Column, end: Column, confidence: Column, tool: Column, rule_id: Column, seq: Column) -> Column:
    values = (phi_type, text, start.cast("int"), end.cast("int"), confidence.cast("double"), tool, rule_id, seq.cast("int"))
    return F.struct(*[v.alias(n) for v, n in zip(values, FIELDS, strict=True)])


def no_spans() -> Column:
    return F.array().cast(EMPTY)


def matches(text: Column, pattern: str, group: int = 0, anchor: str | None = None) -> Column:
    """array<struct<text, start, end>> of all matches, with code point offsets.

    One fold walks over the text's pieces between matches and the matches themselves, so the work is in proportion to
    their number.  A group ends its match, so its start follows from the match's end.
    """
    whole, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.char_length(x["g"]) + F.char_length(x["m"])
        here = F.struct(x["v"].alias("text"), (end - F.char_length(x["v"])).cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(here))).alias("out"))

    pairs = F.arrays_zip(between.alias("g"), whole.alias("m"), groups.alias("v"))
    found = F.aggregate(F.slice(pairs, F.lit(1), F.size(whole)), start, step, lambda acc: acc["out"])
    return F.when(text.rlike(anchor), found) if anchor else found


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule; ``order`` ranks rules among spans of equal start and confidence."""
    found = matches(text, rule.pattern, rule.group, rule.anchor)
    made = F.transform(found, lambda m: span(F.lit(rule.phi_type), m["text"], m["start"], m["end"], F.lit(rule.confidence), F.lit(rule.tool), F.lit(rule.rule_id), F.lit(order)))
    return F.coalesce(made, no_spans())


def scan(text: Column, rules: Iterable[Rule] = PARITY) -> Column:
    """Spans of all rules; nothing is resolved.  Rules that need the same of a text share one test of it."""
    groups: dict[str | None, list[Column]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(r.needs, []).append(rule_spans(text, r, i))
    each = [made if need is None else F.when(text.rlike(GUARDS[need]), made).otherwise(no_spans()) for need, made in ((n, F.concat(*g)) for n, g in groups.items())]
    return F.concat(*each) if each else no_spans()


def scan_types(rules: Iterable[Rule] = PARITY) -> list[str]:
    return sorted({r.phi_type for r in rules})


def ordered(spans: Column) -> Column:
    """By start, then confidence (highest first), then rule order."""

    def compare(a: Column, b: Column) -> Column:
        return (
            F.when(a["start_pos"] != b["start_pos"], F.signum((a["start_pos"] - b["start_pos"]).cast("double")).cast("int"))
            .when(a["confidence"] != b["confidence"], F.signum(b["confidence"] - a["confidence"]).cast("int"))
            .otherwise(F.signum((a["seq"] - b["seq"]).cast("double")).cast("int"))
        )

    return F.array_sort(spans, compare)


def merge_overlaps(spans: Column) -> Column:
    """Left fold over ordered spans: of two that overlap the more confident stays, then the longer, then the earlier.

    Types are not looked at, and a span is compared with the one that stands then, as the stated semantics have it.
    """
    start = F.struct(no_spans().alias("out"), F.lit(None).cast(SPAN).alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        apart = x["start_pos"] >= cur["end_pos"]
        longer = (x["end_pos"] - x["start_pos"]) > (cur["end_pos"] - cur["start_pos"])
        better = (x["confidence"] > cur["confidence"]) | ((x["confidence"] == cur["confidence"]) & longer)
        out = F.when(cur.isNotNull() & apart, F.concat(acc["out"], F.array(cur))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(cur.isNull() | apart | better, x).otherwise(cur).alias("cur"))

    last = lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))
    return F.aggregate(ordered(spans), start, step, last)


def drop_near_duplicates(spans: Column) -> Column:
    """By start, a span goes if it overlaps a kept one with the same text, or by over 0.8 of the shorter of both."""

    def step(kept: Column, x: Column) -> Column:
        def same(k: Column) -> Column:
            overlap = F.least(k["end_pos"], x["end_pos"]) - F.greatest(k["start_pos"], x["start_pos"])
            least = F.least(k["end_pos"] - k["start_pos"], x["end_pos"] - x["start_pos"])
            return (overlap > 0) & ((k["text"] == x["text"]) | F.coalesce(F.try_divide(overlap.cast("double"), least.cast("double")) > 0.8, F.lit(False)))

        return F.when(F.exists(kept, same), kept).otherwise(F.concat(kept, F.array(x)))

    def by_start(a: Column, b: Column) -> Column:
        return F.when(a["start_pos"] != b["start_pos"], F.signum((a["start_pos"] - b["start_pos"]).cast("double")).cast("int")).otherwise(F.signum((a["seq"] - b["seq"]).cast("double")).cast("int"))

    return F.aggregate(F.array_sort(spans, by_start), no_spans(), step)


def distinct_spans(spans: Column) -> Column:
    """The first span of each (text, start, end)."""

    def step(kept: Column, x: Column) -> Column:
        same = F.exists(kept, lambda k: (k["text"] == x["text"]) & (k["start_pos"] == x["start_pos"]) & (k["end_pos"] == x["end_pos"]))
        return F.when(same, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(spans, no_spans(), step)


def repaired(start: Column, end: Column) -> tuple[Column, Column]:
    """Missing places are 0; an end before its start moves to it."""
    start = F.coalesce(start, F.lit(0))
    return start, F.greatest(F.coalesce(end, F.lit(0)), start)


def valid(s: Column) -> Column:
    return (s["confidence"] >= 0) & (s["confidence"] <= 1) & (s["start_pos"] >= 0) & (s["start_pos"] <= s["end_pos"])


def shifted(spans: Column, offset: Column) -> Column:
    """Spans of a chunk in the document's places."""
    return F.transform(spans, lambda s: s.withField("start_pos", (s["start_pos"] + offset).cast("int")).withField("end_pos", (s["end_pos"] + offset).cast("int")))




def place_of(value: Column, content: Column, missing: int = 0) -> Column:
    """First occurrence, from 0; ``missing`` where there is none."""
    at = F.call_function("locate", value, content)
    return F.when(at > 0, at - 1).otherwise(missing).cast("int")


def aligned(value: Column, position: Column, chunk: Column, chunk_start: Column, content: Column) -> Column:
    """Start of a chunk's finding in the document: at its place in the chunk if the text is there, else the next occurrence in the document from the
    chunk's start on, else null."""
    at = chunk_start + position
    there = F.substring(content, at + 1, F.char_length(value)) == value
    later = F.call_function("locate", value, content, (chunk_start + 1).cast("int"))
    return F.when(there, at).when(later > 0, later - 1).cast("int")


def exploded(docs: DataFrame, spans: str = "spans", keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """One row per span: the keys and the span's fields."""
    return docs.select(*keys, F.explode(spans).alias("__s")).select(*keys, "__s.*")


def with_spans(docs: DataFrame, detectors: Iterable[Callable[[Column], Column]], text: str = "text", out: str = "spans", resolve: bool = True) -> DataFrame:
    """All columns of ``docs`` and the detectors' spans, merged unless ``resolve`` is false.  A detector maps a text column to a span array."""
    each = [d(F.col(text)) for d in detectors]
    found = F.concat(*each) if len(each) > 1 else each[0]
    raw = docs.withColumn(out, F.coalesce(found, no_spans()))
    return raw.withColumn(out, merge_overlaps(F.col(out))) if resolve else raw
