"""Cutting texts into chunks with true offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", ", ", " ", "")


def window_bounds(n: Column, size: int = 2000, overlap: int = 100) -> Column:
    """array<struct<start, end>> of windows over n characters: steps of size - overlap until the end is reached, then, if it
    starts later, one more window of the last ``overlap`` characters."""
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: (i * step).cast("int"))
    tail = F.when((overlap > 0) & (n - overlap > last * step), F.array((n - overlap).cast("int"))).otherwise(F.array().cast("array<int>"))
    bounds = F.transform(F.concat(starts, tail), lambda s: F.struct(s.alias("start"), F.least(s + size, n).cast("int").alias("end")))
    return F.when(n > 0, bounds).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def windows(docs: DataFrame, size: int = 2000, overlap: int = 100, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per chunk: keys, chunk_id, start_pos, end_pos, size, content, content_hash."""
    each = docs.select(*keys, F.col(text).alias("__t"), F.posexplode(window_bounds(F.char_length(text), size, overlap)).alias("chunk_id", "__b"))
    content = F.substring("__t", F.col("__b.start") + 1, F.col("__b.end") - F.col("__b.start"))
    out = each.select(*keys, "chunk_id", F.col("__b.start").alias("start_pos"), F.col("__b.end").alias("end_pos"), content.alias("content"))
    return out.withColumns({"size": F.char_length("content"), "content_hash": F.substring(F.sha2("content", 256), 1, 8)})


def slices(text: Column, size: int) -> Column:
    """Slices of equal size without overlap."""
    n = F.char_length(text)
    made = F.transform(F.sequence(F.lit(1), n, F.lit(size)), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))


def estimated_chunks(n: Column, size: int = 500, overlap: int = 50) -> Column:
    return F.greatest(F.lit(1), F.floor(n / (size - overlap))).cast("int")


def total_chunks(n: Column, size: int = 2000, overlap: int = 100) -> Column:
    return F.ceil(n / (size - overlap)).cast("int")


def is_long(text: Column, limit: int = 2000) -> Column:
    return F.char_length(text) > limit


def packed_lines(text: Column, limit: int = 500) -> Column:
    """Lines put together greedily: a line that would take the chunk over the limit opens the next.  Each line counts one more for its break."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        n = F.char_length(line)
        full = acc["cur"].isNotNull() & (acc["n"] + n > limit)
        cur = F.when(acc["cur"].isNull() | full, line).otherwise(F.concat(acc["cur"], F.lit("\n"), line))
        size = F.when(full, n).otherwise(acc["n"] + n + 1)
        return F.struct(F.when(full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"), cur.alias("cur"), size.alias("n"))

    return F.aggregate(F.split(text, "\n", -1), start, step, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))


def _cut(text: str, start: int, size: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
    """Pieces of at most ``size``, cut at the first separator that occurs, finer ones within pieces that are still too long."""
    if len(text) <= size:
        return [(start, start + len(text))] if text else []
    mark = next(s for s in separators if s in text)
    rest = separators[separators.index(mark) + 1 :] or ("",)
    if not mark:
        return [(start + i, start + min(i + size, len(text))) for i in range(0, len(text), size)]
    out, at = [], 0
    while at < len(text):
        end = text.find(mark, at)
        end = len(text) if end < 0 else end + len(mark)
        out += _cut(text[at:end], start + at, size, rest)
        at = end
    return out


def recursive_bounds(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Chunks of whole pieces up to ``size``, each starting with the last pieces, up to ``overlap``, of the one before."""
    pieces, out, first = _cut(text, 0, size, separators), [], 0
    for i, (_, end) in enumerate(pieces):
        if end - pieces[first][0] > size:
            out.append((pieces[first][0], pieces[i - 1][1]))
            nxt = i
            while nxt > first + 1 and pieces[i - 1][1] - pieces[nxt - 1][0] <= overlap and end - pieces[nxt - 1][0] <= size:
                nxt -= 1
            first = nxt
    if pieces:
        out.append((pieces[first][0], pieces[-1][1]))
    return out


def recursive_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per chunk of the recursive splitter: keys, chunk_id, start_pos, end_pos, content.  One Arrow pass."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def bounds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([[{"start": a, "end": b} for a, b in recursive_bounds(t or "", size, overlap)] for t in p])

    each = docs.select(*keys, F.col(text).alias("__t"), F.posexplode(bounds(F.col(text))).alias("chunk_id", "__b"))
    return each.select(*keys, "chunk_id", F.col("__b.start").alias("start_pos"), F.col("__b.end").alias("end_pos"), F.substring("__t", F.col("__b.start") + 1, F.col("__b.end") - F.col("__b.start")).alias("content"))
