"""Large text files by byte ranges: chunks and lines with their places in code points, from many tasks a file.

A file is cut every ``split_bytes`` bytes, wherever that falls.  A range has the characters that begin in it: it leaves out the bytes of a character begun before, and reads on for one that it begins.  A first
pass counts each range's characters and tells whether they are UTF-8; the sums before a range (a row for each range) give its place in the text.  If any range of a file is not UTF-8 the
whole file is Latin-1, as when it is read at once.  Then each range gives the chunks, or lines, that begin in it, and reads as far behind its end as they reach.

With ``joined``, all files under a path, in the order of their names, are one text, as Spark writes a sorted table: they may be cut anywhere, within a character too.  The tasks get the names and sizes of
those files; the path of such a text is the folder's.

A task takes ranges of ``TASK_BYTES`` in all, less while there are fewer than four tasks a core.  Bytes are read by pyarrow in the tasks, so executors need the file system that the paths name.  Empty files have no chunks and no lines; what is returned does not depend on ``split_bytes``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.plans.scratch import written

SPLIT_BYTES = 64 << 20
TASK_BYTES = 64 << 20  #: of the ranges that one task reads, one after another
_RANGE = "path string, first long, until long, length long"


def _opened(path: str):
    system, at = arrow_fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_input_file(at)


class _Joined:
    """Files that follow one another, read as one; ``parts``: (path, first byte, length)."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts, self.at = parts, 0

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        pass

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        out = []
        for path, first, length in self.parts[bisect_right(self.parts, self.at, key=lambda p: p[1] + p[2]) :]:
            if n <= 0:
                break
            with _opened(path) as f:
                f.seek(self.at - first)
                out.append(f.read(min(n, first + length - self.at)))
            self.at, n = self.at + len(out[-1]), n - len(out[-1])
        return b"".join(out)


def _opener(spark: SparkSession, path: str, glob: str | None, joined: bool):
    """How tasks open what a range names: a file, or all files as one."""
    if not joined:
        return _opened
    files = sorted(tuple(r) for r in _found(spark, path, glob).collect())  # names and sizes
    first = [0, *accumulate(n for _, n in files)]
    parts = [(p, at, n) for (p, n), at in zip(files, first, strict=False)]
    return lambda _: _Joined(parts)


def _found(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """path, length of the files that are not empty."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).filter("length > 0").select("path", "length")  # names and sizes alone: nothing is read


def _tail(data: bytes) -> int:
    """How many bytes at the beginning continue a character begun before."""
    n = 0
    while n < min(len(data), 4) and data[n] & 0xC0 == 0x80:
        n += 1
    return n


def _dealt(pieces: DataFrame) -> DataFrame:
    """Ranges over tasks: neither a task for each, which costs more than its range, nor more bytes a task than ``TASK_BYTES``."""
    n, size = pieces.agg(F.count("*"), F.sum(F.col("until") - F.col("first"))).first()
    tasks = min(n, max(-(-(size or 0) // TASK_BYTES), 4 * pieces.sparkSession.sparkContext.defaultParallelism))
    return pieces.repartition(max(1, tasks))


def ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, glob: str | None = None, joined: bool = False) -> DataFrame:
    """path, first, until, length of the byte ranges of all files under a path, dealt over tasks."""
    found = _found(spark, path, glob)
    if joined:
        found = found.agg(F.sum("length").alias("length")).filter("length > 0").select(F.lit(path).alias("path"), "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    return _dealt(written(found.select("path", starts.alias("first"), "length").select("path", "first", F.least(F.col("first") + split_bytes, "length").alias("until"), "length"), "ranges"))


def surveyed(pieces: DataFrame, opened=_opened) -> DataFrame:
    """The ranges with ``utf8`` (of the whole file), ``place`` (code points before it), ``chars`` and ``total`` (of the file)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chars, good = [], []
            for path, first, until in zip(pdf["path"], pdf["first"].tolist(), pdf["until"].tolist(), strict=True):
                with opened(path) as f:
                    f.seek(first)
                    data = f.read(until - first + 4)
                own = data[: until - first]
                skip = _tail(own) if first else 0
                chars.append(int(((np.frombuffer(own, np.uint8) & 0xC0) != 0x80).sum()))
                try:
                    (own[skip:] + data[len(own) : len(own) + _tail(data[len(own) :])]).decode("utf-8")
                    good.append(skip < 4)
                except UnicodeDecodeError:
                    good.append(False)
            yield pdf.assign(chars=chars, good=good)

    counted = written(pieces.mapInPandas(count, _RANGE + ", chars long, good boolean"), "counted")
    whole = counted.groupBy("path").agg(F.every("good").alias("utf8"))
    sized = counted.join(whole, "path").withColumn("chars", F.when(F.col("utf8"), F.col("chars")).otherwise(F.col("until") - F.col("first"))).drop("good")
    before = Window.partitionBy("path").orderBy("first")  # a row for each range of a file
    placed = sized.withColumn("place", F.sum("chars").over(before) - F.col("chars")).withColumn("total", F.sum("chars").over(Window.partitionBy("path")))
    return _dealt(written(placed, "placed"))


def _own(data: bytes, first: int, utf8: bool) -> bytes:
    return data[_tail(data) :] if utf8 and first else data


def chunk_starts(total: int, size: int, overlap: int) -> tuple[int, int | None]:
    """Number of the last regular chunk, and where the chunk of the last ``overlap`` characters begins, if there is one."""
    step = size - overlap
    last = max(-((size - total) // step), 0)
    return last, total - overlap if overlap > 0 and total - overlap > last * step else None


def file_chunks(spark: SparkSession, path: str, size: int = 2000, overlap: int = 100, split_bytes: int = SPLIT_BYTES, glob: str | None = None, joined: bool = False) -> DataFrame:
    """path, chunk_id, start_pos, end_pos, content, size, content_hash: the chunks that ``chunking.windows`` cuts from the whole text."""
    if not 0 <= overlap < size:
        raise ValueError("chunks overlap by less than their size")
    opened = _opener(spark, path, glob, joined)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                with opened(r.path) as f:
                    f.seek(r.first)
                    data = f.read(r.until - r.first + 4 * size + 4)
                text = _own(data, r.first, r.utf8).decode("utf-8" if r.utf8 else "latin-1", "ignore")  # only the last character can be cut off
                last, tail = chunk_starts(r.total, size, overlap)
                step = size - overlap
                begins = [(i, i * step) for i in range(-(-r.place // step), min(last, (r.place + r.chars - 1) // step) + 1)]
                if tail is not None and r.place <= tail < r.place + r.chars:
                    begins.append((last + 1, tail))
                rows = [(r.path, i, s, min(s + size, r.total), text[s - r.place : min(s + size, r.total) - r.place]) for i, s in begins]
                yield pd.DataFrame(rows, columns=["path", "chunk_id", "start_pos", "end_pos", "content"])

    chunks = surveyed(ranges(spark, path, split_bytes, glob, joined), opened).mapInPandas(cut, "path string, chunk_id long, start_pos long, end_pos long, content string")
    return chunks.withColumns({"size": F.char_length("content"), "content_hash": F.substring(F.sha2("content", 256), 1, 8)})


def file_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, glob: str | None = None, read_on: int = 1 << 16, joined: bool = False) -> DataFrame:
    """path, start_pos, line of all lines (ended by a line feed; what follows the last one is a line if it is not empty)."""
    opened = _opener(spark, path, glob, joined)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                with opened(r.path) as f:
                    f.seek(max(r.first - 1, 0))
                    data = f.read(r.until - max(r.first - 1, 0))
                    own = data[1:] if r.first else data
                    begin = 0 if not r.first or data[:1] == b"\n" else own.find(b"\n") + 1
                    if begin >= len(own) or (begin == 0 and r.first and data[:1] != b"\n"):
                        continue  # no line begins here
                    rest = b""
                    while not own.endswith(b"\n") and b"\n" not in rest[-read_on:] and (more := f.read(read_on)):
                        rest += more
                line_bytes = (own + rest[: rest.find(b"\n") + 1 if b"\n" in rest else len(rest)])[begin:]
                marks = (np.frombuffer(own, np.uint8) & 0xC0) != 0x80 if r.utf8 else np.ones(len(own), bool)
                before = np.concatenate([[0], np.cumsum(marks)])
                rows, at = [], begin
                for line in line_bytes.removesuffix(b"\n").split(b"\n"):
                    rows.append((r.path, int(r.place + before[at]), line.decode("utf-8" if r.utf8 else "latin-1")))
                    at += len(line) + 1
                yield pd.DataFrame(rows, columns=["path", "start_pos", "line"])

    return surveyed(ranges(spark, path, split_bytes, glob, joined), opened).mapInPandas(split, "path string, start_pos long, line string")


