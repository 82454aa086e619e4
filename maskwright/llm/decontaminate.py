"""Benchmark passages in documents, by Wu-Manber search for many word patterns at once.

Every ``window`` consecutive words of a benchmark item are a pattern; a shorter item is one pattern.  Patterns of one length
share a search: a shift table over hashed blocks of two words tells how far the window of the search may move
without passing over an occurrence, a block with shift 0 leads to the bucket of its hash, and the patterns there are compared word by word.
Documents are read once, without a shuffle.

The benchmark is broadcast in blocks of at most ``block_words`` words; a larger one is searched block by block and the hits of
a document are put together by its row.

Defined results: null or wordless texts have no words and no hits; items without words or with a null id have no patterns; repeated
items and rows count once each; input columns named like the added ones give way to them.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, without, words_of

TABLE_BITS = (16, 26)  #: least and largest logarithm of a shift table's places, of which there are eight for each block of the patterns

_built: dict[str, Patterns] = {}  #: the last benchmark block's patterns of this worker, which later tasks use again


def _patterns(name: str, block: list[tuple[str, str]], window: int) -> Patterns:
    if name not in _built:
        _built.clear()
        _built[name] = Patterns(block, window)
    return _built[name]


class Search:
    """All patterns of one length over word numbers."""

    def __init__(self, length: int, patterns: dict[bytes, set[str]]):
        self.length, self.block = length, min(2, length)
        blocks = 8 * len({raw[4 * i : 4 * (i + self.block)] for raw in patterns for i in range(length - self.block + 1)})
        self.bits = min(max(blocks.bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int8 if length < 127 else np.int32)
        self.buckets: dict[int, list[tuple[bytes, tuple[str, ...]]]] = defaultdict(list)
        for raw, items in patterns.items():
            h = self.hashes(np.frombuffer(raw, np.int32))
            np.minimum.at(self.shift, h, np.arange(len(h) - 1, -1, -1, dtype=self.shift.dtype))
            self.buckets[int(h[-1])].append((raw, tuple(items)))

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """Table place of the block that ends at each word from ``block - 1`` on."""
        x = ids.astype(np.uint64)
        if self.block == 2:
            x = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        else:
            x = x * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(start, items) of all occurrences."""
        m, back = self.length, self.block - 1
        if len(ids) < m:
            return
        places = self.hashes(ids)
        shifts = self.shift[places]
        i, n = m - 1, len(ids)
        while i < n:
            step = int(shifts[i - back])
            if step:
                i += step
                continue
            here = ids[i - m + 1 : i + 1].tobytes()
            for raw, items in self.buckets.get(int(places[i - back]), ()):
                if raw == here:
                    yield i - m + 1, items
            i += 1


class Patterns:
    """Word numbers and searches of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], np.int32)
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1) if m else ():
                found[m][ids[i : i + m].tobytes()].add(item)
        self.searches = [Search(m, p) for m, p in sorted(found.items())]

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; disjoint hit ranges [start, end); items that occur."""
        words = words_of(text)
        ids = np.fromiter((self.numbers.get(w, 0) for w in words), np.int32, len(words))
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for s in self.searches:
            for start, own in s.find(ids):
                items.update(own)
                ranges.append((start, start + s.length))
        return len(words), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items, in blocks that are small enough to be broadcast.  One block at a time is on the driver."""
    block: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null").distinct()
    for r in rows.toLocalIterator():
        n = len(words_of(r["t"]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: tuple[int, int] = (1, 20), text: str = "text", item_id: str = "item_id", block_words: int = 2_000_000
) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, spans (hit word ranges), items (ids as text, sorted) and contaminated.

    A document is contaminated if it has a hit word and hit words are at least ``share`` (num, den) of its words.
    """
    added = ("n_words", "n_hit", "spans", "items", "contaminated")
    docs = without(docs, *added)
    spark = docs.sparkSession
    num, den = share
    kind = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"

    def searched(rows: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        @F.pandas_udf(kind)
        def hits(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            patterns = _patterns(name, sent.value, window)
            for p in parts:
                out = [patterns.hits(t) for t in p]
                yield pd.DataFrame({
                    "n_words": [n for n, _, _ in out],
                    "spans": [[{"start": a, "end": b} for a, b in r] for _, r, _ in out],
                    "items": [sorted(i) for _, _, i in out],
                })

        return rows.withColumn("__hits", hits(F.col(text)))

    blocks = _blocks(benchmark, item_id, text, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        out = searched(docs, first)
    else:
        rows = materialize(docs.withColumn("__row", F.expr("uuid()")), "rows")
        found = None
        for block in [first, second]:
            part = materialize(searched(rows.select("__row", text), block).select("__row", "__hits"), "hits")
            found = part if found is None else found.unionByName(part)
        for block in blocks:
            found = found.unionByName(materialize(searched(rows.select("__row", text), block).select("__row", "__hits"), "hits"))

        @F.pandas_udf("array<struct<start:long,end:long>>")
        def joined(lists: pd.Series) -> pd.Series:
            return pd.Series([[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in some])] for some in lists])

        together = found.groupBy("__row").agg(
            F.max("__hits.n_words").alias("n_words"), F.flatten(F.collect_list("__hits.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__hits.items")))).alias("items")
        )  # a row per block and document: bounded by the number of blocks
        together = together.select("__row", F.struct("n_words", joined("spans").alias("spans"), "items").alias("__hits"))
        out = rows.join(together, "__row")
    hit = F.aggregate("__hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = out.select(*docs.columns, "__hits.n_words", hit.alias("n_hit"), "__hits.spans", "__hits.items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (den * F.col("n_hit") >= num * F.col("n_words")))
