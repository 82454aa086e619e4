"""Pairs of overlapping spans of two tables, by bins of positions.

Spans (start included, end excluded) are dealt to bins whose width fits their length, so each lies in one or two of them, and also to the bins of each larger width that occurs,
where the other table's longer spans are met.  A pair meets in every bin both have; it is kept in the first of these, at the larger of their widths, so once.
Bins with many spans of the left table are split: those spans are dealt over parts by their hash, and the right table's are sent to each part.

Cost: a row is sent a few times for each width that occurs (widths grow fourfold, so some thirty for any positions), however long it is; a bin's pairs are
its true overlaps and near misses of one bin's width.  No other pairs are made.  Spans that are empty, reversed or have a null overlap nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.plans.scratch import written

SPLIT = 20_000  #: spans of the left table in a bin from which it is split
HOT_BINS = 1_000_000  #: split bins that may be broadcast; beyond, the join shuffles


def _width(start: Column, end: Column) -> Column:
    """The exponent (of 4) of the least width that is no smaller than the span."""
    return F.ceil(F.log(4.0, (end - start).cast("double")) - 1e-9).cast("int")


def _bin(position: Column, level: Column) -> Column:
    return F.call_function("shiftright", position, 2 * level)


def _ready(df: DataFrame, side: str, keys: Sequence[str], start: str, end: str) -> DataFrame:
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    row = F.struct(*df.columns).alias(side)
    out = df.filter(s < e).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], row, s.alias("s"), e.alias("e"))
    return out.withColumn("own", _width(F.col("s"), F.col("e")))


def _dealt(df: DataFrame, levels: list[int]) -> DataFrame:
    """Each span in its bins of its own width and of each larger one."""
    larger = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("own"))
    each = df.withColumn("level", F.explode(larger))
    first = _bin(F.col("s"), F.col("level"))
    return each.withColumn("first", first).withColumn("bin", F.explode(F.sequence(first, _bin(F.col("e") - 1, F.col("level")))))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), start: str = "start_pos", end: str = "end_pos", split: int = SPLIT) -> DataFrame:
    """One row (left: struct, right: struct, overlap: positions in common) for each pair of spans with equal ``keys`` that overlap."""
    a, b = _ready(left, "left", keys, start, end), _ready(right, "right", keys, start, end)
    found = a.select("own").union(b.select("own")).distinct().collect()  # a row for each width: some thirty
    levels = sorted(r["own"] for r in found)
    if not levels:
        levels = [0]
    names = [f"__k{i}" for i in range(len(keys))]
    by = [*names, "level", "bin"]
    a, b = written(_dealt(a, levels), "spans"), written(_dealt(b, levels), "spans")
    full = written(a.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > split).select(*by, F.ceil(F.col("n") / split).cast("int").alias("parts")), "bins")
    full = F.broadcast(full) if full.count() <= HOT_BINS else full
    parts = F.coalesce("parts", F.lit(1))
    content = F.xxhash64("s", "e", F.to_json("left"))
    a = a.join(full, by, "left").withColumn("part", F.pmod(content, parts).cast("int")).drop("parts")
    b = b.join(full, by, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    side = lambda df, n: df.select(*by, "part", n, *[F.col(c).alias(f"{n}_{c}") for c in ("s", "e", "own", "first")])
    a, b = side(a, "left"), side(b, "right")
    here = lambda n: F.col(f"{n}_own") == F.col("level")
    # one side at least is of the bins' own width: two shorter spans have met at a smaller one
    pairs = a.filter(here("left")).join(b, [*by, "part"]).unionByName(a.filter(~here("left")).join(b.filter(here("right")), [*by, "part"]))
    meet = (F.col("left_s") < F.col("right_e")) & (F.col("right_s") < F.col("left_e")) & (F.col("bin") == F.greatest("left_first", "right_first"))
    common = F.least("left_e", "right_e") - F.greatest("left_s", "right_s")
    return pairs.filter(meet).select("left", "right", common.alias("overlap"))
