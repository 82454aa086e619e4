"""Passages that repeat within and across documents, by content-defined chunks.

A gear hash rolls over the text's bytes: h = 2 h + gear[byte], of which the bits that decide depend on the last 32 bytes
alone.  A chunk ends where these bits are zero (one byte in ``average``), so the same passage is cut alike wherever it stands and
insertions before it do not shift its chunks.  A stretch without a cut is cut every ``longest`` bytes from its start.

A window begins at each chunk and ends with the chunk that takes it to ``min_chars`` code points.  Windows are compared by 128-bit digests of
their bytes, which decide (texts are not compared again), in one packed shuffle of (digest, document, place).  A digest found more than once
marks all its windows as repeated and all but its first occurrence (smallest doc_id, then smallest place) as droppable, so each code point
that goes lies in a stretch of ``min_chars`` and more that stands, character by character, at an earlier place too.  Windows that touch make a run.
Occurrences from the third on within a task's flush are repeated and not first for certain: they pass by the others, so a common window
sends two rows a flush to the task where its digest meets, and a digest's occurrences leave it as one row each.

Of a repeated passage the chunk it begins in (cuts agree 32 bytes on at the latest) and those it ends in may stay; of a stretch that repeats
itself its first chunk stays.

Defined results: a ``doc_id`` is a whole number or null; null and empty texts have no chunks and stay, as do texts shorter than ``min_chars``; rows without a ``doc_id`` stay unchanged, with
no spans; a ``doc_id`` must not stand for different texts (equal rows of one id are one document: all stay, and their windows count
once); input columns named like the added ones give way to them; empty tables give empty ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, mix64, split_packed, text_bytes, without

ENTRIES = 400_000  #: chunks that a reducer's group is meant to hold
BROADCAST_NUMBERS = 2_000_000  #: numbers of 8 bytes in spans that may be broadcast; beyond, texts and spans meet in a shuffle
REACH = 32  #: bytes that decide a cut
GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def cuts(data: bytes, average: int, longest: int) -> np.ndarray:
    """Ends of the chunks of ``data``; the last is its length."""
    if not data:
        return np.zeros(0, np.int64)
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < REACH:  # after each doubling, h sums the last 2 * step bytes with their shifts
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    ends = np.flatnonzero(h < np.uint32((1 << 32) // average)) + 1
    ends = np.append(ends[ends < len(data)], len(data))
    gaps = np.diff(ends, prepend=0)
    if (gaps > longest).any():
        more = [np.arange(e - g + longest, e, longest) for e, g in zip(ends[gaps > longest], gaps[gaps > longest], strict=True)]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def windows(data: bytes, ends: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests, as (n, 2) uint64, and codes (start << 16 | size, in code points) of the windows of at least ``least`` code points."""
    starts = np.concatenate([[0], places[:-1]])
    last = np.searchsorted(places, starts + least)
    whole = last < len(places)
    starts, last = starts[whole], last[whole]
    begins = np.concatenate([[0], ends[:-1]])[whole]
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(data[a:b]) for a, b in zip(begins.tolist(), ends[last].tolist(), strict=True)])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2), starts << 16 | (places[last] - starts)


def runs(codes: np.ndarray) -> list[int]:
    """Starts and ends, in turn, of the union of windows.  ``codes``: start << 20 | size << 1 | first."""
    codes = np.unique(codes)
    if not len(codes):
        return []
    start = codes >> 20
    end = np.maximum.accumulate(start + ((codes >> 1) & 0x7FFFF))
    opens = np.concatenate([[True], start[1:] > end[:-1]])
    return np.stack([start[opens], end[np.concatenate([opens[1:], [True]])]], 1).ravel().tolist()


def code_point_ends(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Ends in bytes as ends in code points; a cut within a character moves behind it."""
    started = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return started[ends - 1]


def repeated_windows(docs: DataFrame, min_chars: int = 128, average: int = 20, longest: int = 256, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc and code (start << 20 | size << 1 | whether this is the digest's first occurrence; code points) of every window whose digest occurs twice or more."""
    base = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).filter("d is not null and t is not null")
    parts = max(1, math.ceil(text_bytes(docs, text) / average / ENTRIES))

    def ordered(key: np.ndarray, doc: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, documents and spans sorted, equal rows once, and where a key begins."""
        order = np.lexsort((span, doc, key[:, 1], key[:, 0]))
        key, doc, span = key[order], doc[order], span[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]).any(1)])
        other = np.concatenate([[True], new[1:] | (doc[1:] != doc[:-1]) | (span[1:] != span[:-1])])
        return key[other], doc[other], span[other], new[other]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            key, doc, span, new = ordered(*(np.concatenate([h[i] for h in held]) for i in range(3)))
            starts = np.flatnonzero(new)
            third = np.arange(len(key)) - starts[np.cumsum(new) - 1] > 1
            rest = ~third
            rows = [(p, x[0], x[1], x[2], x[3], None) for p, x in split_packed(key[rest, 0], parts, key[rest, 1], doc[rest], span[rest])]
            if third.any():
                rows.append((int(key[0, 0] % np.uint64(parts)), None, None, None, None, np.stack([doc[third], span[third]]).tobytes()))
            return pd.DataFrame(rows, columns=["p", "key", "low", "doc", "span", "more"])

        for pdf in batches:
            for d, t in zip(pdf["d"].tolist(), pdf["t"], strict=True):
                data = t.encode("utf-8", "surrogatepass")
                ends = cuts(data, average, longest)
                if len(ends):
                    keys, codes = windows(data, ends, code_point_ends(data, ends), min_chars)
                    if len(codes):
                        held.append((keys, np.full(len(codes), d, np.int64), codes))
                        size += len(codes)
                if size > 200_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        some, out = pdf[pdf["key"].notna()], []
        if len(some):
            key = np.stack([np.frombuffer(b"".join(some[c]), np.uint64) for c in ("key", "low")], 1)
            key, doc, span, new = ordered(key, *(np.frombuffer(b"".join(some[c]), np.int64) for c in ("doc", "span")))
            run = np.cumsum(new) - 1
            again = np.bincount(run)[run] > 1
            out.append((doc[again], span[again], new[again]))
        for more in pdf["more"].dropna():
            d, s = np.frombuffer(more, np.int64).reshape(2, -1)
            out.append((d, s, np.zeros(len(d), bool)))
        doc, span, first = (np.concatenate([o[i] for o in out]) for i in range(3))
        return pd.DataFrame({"doc": doc, "code": (span >> 16) << 20 | (span & 0xFFFF) << 1 | first})

    dealt = base.mapInPandas(deal, "p int, key binary, low binary, doc binary, span binary, more binary")
    return dealt.groupBy("p").applyInPandas(meet, "doc long, code long")


def drop_repeats(docs: DataFrame, min_chars: int = 128, average: int = 20, longest: int = 256, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with the text less its droppable runs, and repeated, dropped (spans in code points), n_repeated, n_dropped (code points).

    ``repeated`` has every run of windows that occur elsewhere too, first occurrences included; ``dropped`` those of windows that occur earlier.
    """
    docs = without(docs, "repeated", "dropped", "n_repeated", "n_dropped")
    found = repeated_windows(docs, min_chars, average, longest, text, doc_id)

    @F.pandas_udf("r array<long>, x array<long>")
    def joined_runs(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"r": [runs(c) for c in codes], "x": [runs(c[c & 1 == 0]) for c in codes]})

    # a row per document with a repeated window; its codes are no more than its own chunks
    own = found.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list("code").alias("codes"))
    spans = own.select("__doc", joined_runs("codes").alias("s")).select("__doc", F.col("s.r").alias("__r"), F.col("s.x").alias("__x"))
    spans = materialize(spans.filter(F.size("__r") > 0), "spans")

    size = spans.agg(F.coalesce(F.sum(F.size("__r") + F.size("__x") + 4), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(spans) if size <= BROADCAST_NUMBERS else spans, F.col(doc_id) == F.col("__doc"), "left")
    even, odd = (lambda c: F.filter(c, lambda v, i: i % 2 == 0)), (lambda c: F.filter(c, lambda v, i: i % 2 == 1))
    none = F.array().cast("array<long>")
    r, x = F.coalesce("__r", none), F.coalesce("__x", none)
    kept = F.zip_with(  # the pieces between dropped runs
        F.concat(F.array(F.lit(0).cast("long")), odd(x)), F.concat(even(x), F.array(F.char_length(text).cast("long"))),
        lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int")),
    )
    left = F.when(F.size(x) > 0, F.array_join(kept, "")).otherwise(F.col(text))
    pairs = lambda c: F.zip_with(even(c), odd(c), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    total = lambda c: F.aggregate(F.zip_with(even(c), odd(c), lambda a, b: b - a), F.lit(0).cast("long"), lambda n, v: n + v)
    return joined.select(*[left.alias(c) if c == text else F.col(c) for c in docs.columns], pairs(r).alias("repeated"), pairs(x).alias("dropped"), total(r).alias("n_repeated"), total(x).alias("n_dropped"))
