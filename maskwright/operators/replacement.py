"""Many values replaced at once: a text is read one time, the leftmost and there the longest value is replaced, and what was put in is not looked at again.

Values of up to ``BLOCK_BYTES`` go to the tasks as one automaton.  More of them are taken in blocks of that size: each block gives the longest value at each place of each text,
and the places of all blocks are then settled text by text, so the result does not depend on the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.plans.scratch import written

BLOCK_BYTES = 8 << 20  #: of values and masks in one automaton
PIECE = 256  #: texts of an Arrow batch that are strings of Python at once


class Replacer:
    """A function of a text, from values and their masks.  Empty values do not count."""

    def __init__(self, pairs: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for value, mask in pairs.items():
            if value:
                self.automaton.add_word(value, (len(value), mask))
        self.any = len(self.automaton) > 0
        self.automaton.make_automaton()

    def places(self, text: str) -> dict[int, tuple[int, str]]:
        """start -> (end, mask) of the longest value at each place that has one."""
        found: dict[int, tuple[int, str]] = {}
        if self.any:
            for last, (n, mask) in self.automaton.iter(text):
                start = last - n + 1
                if start not in found or found[start][0] <= last:
                    found[start] = (last + 1, mask)
        return found

    def __call__(self, text: str | None) -> str | None:
        return spliced(text, self.places(text)) if text else text


def spliced(text: str, places: dict[int, tuple[int, str]]) -> str:
    """The text with the leftmost of the places replaced, then the leftmost behind it, and so on."""
    out, at = [], 0
    for start in sorted(places):
        if start >= at:
            end, mask = places[start]
            out += [text[at:start], mask]
            at = end
    return "".join([*out, text[at:]])


def one_mask(pairs: DataFrame) -> DataFrame:
    """value and masked, once a value (the least mask); without empty values and nulls."""
    return pairs.filter("value <> '' and masked is not null").groupBy("value").agg(F.min("masked").alias("masked"))


def replacing(pairs: dict[str, str]) -> Callable[[Column], Column]:
    """The replacement as a function of columns, for pairs that the caller holds."""
    made: list[Replacer] = []

    @F.arrow_udf("string")
    def replace(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Replacer(pairs))
        pieces = (texts.slice(i, PIECE).to_pylist() for i in range(0, len(texts), PIECE))  # few texts of a batch are Python's at a time
        return pa.concat_arrays([pa.array([made[0](t) for t in piece], texts.type) for piece in pieces] or [texts])

    return replace


def replace_all(df: DataFrame, pairs: DataFrame, columns: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with all ``pairs`` (value, masked) applied to string columns at once."""
    known = written(one_mask(pairs), "pairs")
    size = known.agg(F.sum(F.octet_length("value") + F.octet_length("masked"))).first()[0] or 0
    if size <= block_bytes:
        apply = replacing({r["value"]: r["masked"] for r in known.collect()})  # block_bytes at most
        return df.withColumns({c: apply(F.col(c)) for c in columns})
    blocks = -(-size // block_bytes)
    rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    dealt = written(known.withColumn("__block", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int")), "blocks")
    texts = rows.select("__row", *columns)
    parts = [written(_places(texts, dealt.filter(F.col("__block") == b), columns), "places") for b in range(blocks)]
    while len(parts) > 1:  # in pairs, so that the plan is no deeper than it has to be
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    listed = parts[0].groupBy("__row").agg(F.collect_list(F.struct("column", "start", "end", "masked")).alias("__places"))
    schema = rows.schema

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, c in enumerate(columns):
                out = []
                for text, places in zip(pdf[c], pdf["__places"], strict=True):
                    best: dict[int, tuple[int, str]] = {}
                    for p in places if places is not None else ():
                        if p["column"] == i and (p["start"] not in best or best[p["start"]][0] < p["end"]):
                            best[p["start"]] = (p["end"], p["masked"])
                    out.append(spliced(text, best) if best else text)
                pdf[c] = out
            yield pdf.drop(columns="__places")

    hit = rows.join(listed, "__row")
    changed = hit.select(*schema.names, "__places").mapInPandas(settle, schema)
    return rows.join(listed.select("__row"), "__row", "left_anti").unionByName(changed).drop("__row")


def _places(texts: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The longest value of a block at each place of each text."""
    block = {r["value"]: r["masked"] for r in pairs.collect()}  # a block's bytes at most

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replacer = Replacer(block)
        for pdf in batches:
            rows = [(row, i, start, end, mask) for i, c in enumerate(columns) for row, text in zip(pdf["__row"], pdf[c], strict=True) if text for start, (end, mask) in replacer.places(text).items()]
            yield pd.DataFrame(rows, columns=["__row", "column", "start", "end", "masked"])

    return texts.mapInPandas(find, "__row long, column int, start long, end long, masked string")
