"""Periodic runs: stretches of words that repeat with a smallest period, found by uniting suffixes by falling common prefix.

Within a task, for each whole text: the suffixes of its words are sorted by prefix doubling and neighbours' longest common
prefixes (LCP) are read off the ranks.  Neighbouring suffixes are then united in order of falling LCP (as Kruskal's
algorithm takes edges), each class of a union-find keeping its positions in order; the smaller class is merged into the larger.
Two positions that become neighbours in a class have exactly the LCP of the union; where their distance is no more than the LCP, they seed a run.

Why no run is lost and none is found twice: let a run start at i with smallest period q and reach to i + q + L.  Then i and
i + q have LCP L, and with L >= q no position between them is in their class by then (it would give the run a smaller period),
so the union at L makes them neighbours, once.  A seed whose words before both positions are equal starts inside a run and is passed over.

A run has at least ``least_words`` words and ``least_times`` periods, so its seed has an LCP of at least
``max(least_words - q, (least_times - 1) * q)``; unions below the least LCP that any period allows are not made.  Only texts that repeat a stretch
of that length are sorted at all, which two equal hashes of such stretches show.

Cost: n log n words of a text to sort and to merge, a few dozen bytes a word in memory, and 4 bytes a word for each doubling of the
longest repeat.  Texts are handled one by one, whole, in Arrow batches; nothing is shuffled.

Defined results: a null, empty or blank text has no words and no runs, and collapses to an empty text; rows without an id, repeated rows and
further columns go along as they are (columns named like those added are replaced); an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from maskwright.llm.common import mix64, without

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
ADDED = ("n_words", "runs", "collapsed")


def least_prefix(least_words: int, least_times: int) -> int:
    """The smallest LCP that a seed of a run can have, over all periods."""
    return min(max(least_words - q, (least_times - 1) * q) for q in range(1, least_words + 1))


def _may_repeat(codes: np.ndarray, length: int) -> bool:
    """Whether any stretch of ``length`` words may occur twice; false only if none does."""
    if len(codes) <= length:
        return False
    h = mix64(codes.astype(np.uint64))
    n = len(codes) - length + 1
    out = h[:n].copy()
    for k in range(1, length):
        out = mix64(out + h[k : n + k] * np.uint64(2 * k + 1))
    out.sort()
    return bool((out[1:] == out[:-1]).any())


def suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and the LCP of each suffix with the one before it (0 for the first)."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int32)
    levels, span = [rank], 1
    while True:
        after = np.zeros(n, np.int64)
        if span < n:
            after[: n - span] = rank[span:].astype(np.int64) + 1
        key = (rank.astype(np.int64) << 32) | after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.int32)
        if fresh[-1] == n - 1:
            break
        rank = np.empty(n, np.int32)
        rank[order] = fresh
        levels.append(rank)
        span *= 2
    # equal ranks at a level are equal stretches of its span (ends of the text differ from all words): step down the levels
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b, common = order[:-1].astype(np.int64), order[1:].astype(np.int64), lcp[1:]
        for level in range(len(levels) - 1, -1, -1):
            x, y = a + common, b + common
            live = np.flatnonzero((x < n) & (y < n))
            same = live[levels[level][x[live]] == levels[level][y[live]]]
            common[same] += 1 << level
    return order, lcp


def runs_of(codes: np.ndarray, least_words: int = 6, least_times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start and period."""
    floor = least_prefix(least_words, least_times)
    if not _may_repeat(codes, floor):
        return []
    order, lcp = suffixes(codes)
    edges = np.flatnonzero(lcp >= floor)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    seen = codes.tolist()
    group: dict[int, list[int]] = {}  # position -> the ordered list of its class
    out = []
    for a, b, common in zip(order[edges - 1].tolist(), order[edges].tolist(), lcp[edges].tolist(), strict=True):
        large, small = group.get(a) or [a], group.get(b) or [b]
        if len(large) < len(small):
            large, small = small, large
        new, at = [], 0
        for i, x in enumerate(small):
            at = bisect_left(large, x, at)
            if at and (i == 0 or small[i - 1] < large[at - 1]):
                new.append((large[at - 1], x))
            if at < len(large) and (i + 1 == len(small) or small[i + 1] > large[at]):
                new.append((x, large[at]))
        for p, q in new:
            d = q - p
            if common >= (least_times - 1) * d and common + d >= least_words and (p == 0 or seen[p - 1] != seen[q - 1]):
                out.append((p, common + d, d))
        if len(small) < 16:
            for x in small:
                large.insert(bisect_left(large, x), x)
        else:
            large.extend(small)
            large.sort()  # two ordered stretches: one merge
        for x in small:
            group[x] = large
        group[a] = group[b] = large
    return sorted(out)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays when every run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def coded(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def find_runs(
    docs: DataFrame, text: str = "text", least_words: int = 6, least_times: int = 4, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None, key: str | None = None
) -> DataFrame:
    """``docs`` with n_words, runs (by start, then period) and collapsed (the words that no run repeats, joined by a space).

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``prepare`` may change a row's words first; it gets the column ``key`` and the words.
    """
    if least_times < 2 or least_words < 2:
        raise ValueError("a run needs two periods and two words at least")
    own = without(docs, *ADDED)
    schema = StructType([*own.schema.fields, StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    at = own.columns.index(text)
    by = own.columns.index(key) if key else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))
        for batch in batches:
            counts, found, texts = [], [], []
            keys = batch.column(by).to_pylist() if by is not None else [None] * batch.num_rows
            for k, t in zip(keys, batch.column(at), strict=True):
                raw = t.as_py()
                words = raw.encode("utf-8", "surrogatepass").split() if raw else []
                if prepare:
                    words = prepare(k, words)
                runs = runs_of(coded(words), least_words, least_times)
                kept = words if not runs else [w for w, stays in zip(words, kept_words(len(words), runs).tolist(), strict=True) if stays]
                counts.append(len(words))
                found.append([dict(zip(RUN.names, r, strict=True)) for r in runs])
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], names=schema.names)

    return own.mapInArrow(scan, schema)


def longest(runs: str = "runs"):
    """The run of greatest length, ties by smallest start, then period; null without runs."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("neg"), r["start"].alias("start"), r["period"].alias("period"))))
