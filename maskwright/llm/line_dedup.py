"""Lines that many documents share, found with two Bloom filters and confirmed exactly.

Pass 1 builds, in each task, a filter of line keys seen once and one of keys seen twice; merging takes
once = A | B and twice = A2 | B2 | (A1 & B1), so a key of two tasks is never missed (a few others are suspected too).
Pass 2 sends only keys that the merged twice-filter suspects through a shuffle, where they are counted exactly
(one row per document and key, combined on the map side) and get their first occurrence.
Pass 3 drops the confirmed lines.

The filters are sized for the lines there are, up to ``max_filter_bits`` (32 MiB by default): beyond that they
fill up and more keys are suspected, which costs shuffle and never changes a result.  The confirmed keys are
broadcast up to ``max_broadcast_keys`` as digests of 16 bytes; above, they come back by a join on the line's key.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased.  Null or empty texts
are one empty line.  Keys shorter than ``min_chars`` code points are never dropped.  Each row is a document,
also where a ``doc_id`` stands in several rows.  A ``doc_id`` is a whole number or null; rows without one are documents like others, first of all
where ``keep="first"`` asks for the smallest.  Empty tables give empty ones; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import BLANKS, materialize, without

SEGMENTS = 512  #: parts of a filter that are merged apart from each other


def line_keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """Lines and their keys as UTF-8; the key of a line below ``min_chars`` is b''."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys = [x.strip(BLANKS).lower() for x in lines]
    if min_chars > 1:
        keys = [k if len(k) >= min_chars and len(k.decode("utf-8", "surrogatepass")) >= min_chars else b"" for k in keys]
    return lines, keys


def _digest(key: bytes) -> bytes:
    """128 bits; md5, since Spark's functions have it too."""
    return hashlib.md5(key, usedforsecurity=False).digest()


def _bits(digests: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """(n, hashes) bit numbers of digests given as (n, 2) uint64: double hashing."""
    return (digests[:, :1] + np.arange(hashes, dtype=np.uint64) * (digests[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def filter_shape(lines: int, max_filter_bits: int) -> tuple[int, int]:
    """Bits (a power of two) and hash functions for so many keys."""
    want = max(1 << 16, 16 * max(lines, 1))
    bits = min(1 << math.ceil(math.log2(want)), 1 << int(math.log2(max_filter_bits)))
    return bits, max(1, min(4, round(0.69 * bits / max(lines, 1))))


def suspected_filter(docs: DataFrame, text: str, min_chars: int, max_filter_bits: int) -> tuple[bytes, int, int]:
    """The merged twice-filter: bytes, bits and hash functions.  Bounded by ``max_filter_bits``."""
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.length(text) - F.length(F.regexp_replace(F.col(text), "\n", "")) + 1).alias("n")).first()["n"] or 0
    bits, hashes = filter_shape(int(lines), max_filter_bits)
    part = bits // 8 // SEGMENTS

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for pdf in batches:
            digests = b"".join([_digest(k) for t in pdf["t"] for k in set(line_keys(t, min_chars)[1]) if k])
            at = _bits(np.frombuffer(digests, np.uint64).reshape(-1, 2), bits, hashes)
            # keys one at a time would be slow: of keys with all bits set before, or set by others here, none may be missed
            flat = at.ravel()
            known = ((once[flat >> np.uint64(3)] >> (flat & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
            again = (known | (count[back] > 1)).reshape(at.shape).all(1)
            for filled, some in ((twice, at[again].ravel()), (once, flat)):
                np.bitwise_or.at(filled, (some >> np.uint64(3)).astype(np.int64), np.uint8(1) << (some & np.uint64(7)).astype(np.uint8))
        used = np.flatnonzero(once.reshape(SEGMENTS, part).any(1))
        for i in range(0, len(used), 64):
            some = [int(s) for s in used[i : i + 64]]
            yield pd.DataFrame({"segment": some, "once": [once[s * part : (s + 1) * part].tobytes() for s in some], "twice": [twice[s * part : (s + 1) * part].tobytes() for s in some]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(part, np.uint8), np.zeros(part, np.uint8)
        for a, b in zip(pdf["once"], pdf["twice"], strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            twice |= b | (once & a)
            once |= a
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "twice": [twice.tobytes()]})

    builders = 4 * spark.sparkContext.defaultParallelism  # each sends a filter at most, whatever the number of files
    built = docs.select(F.col(text).alias("t")).coalesce(builders).mapInPandas(build, "segment int, once binary, twice binary")
    merged = built.groupBy("segment").applyInPandas(merge, "segment int, twice binary")
    out = bytearray(bits // 8)
    for row in merged.toLocalIterator():  # max_filter_bits at most
        out[row["segment"] * part : (row["segment"] + 1) * part] = row["twice"]
    return bytes(out), bits, hashes


def repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id", max_filter_bits: int = 1 << 28) -> DataFrame:
    """key, n_docs and first_doc of every line key found in at least ``min_docs`` documents, counted exactly."""
    spark = docs.sparkSession
    filled, bits, hashes = suspected_filter(docs, text, min_chars, max_filter_bits)
    sent = spark.sparkContext.broadcast(filled)

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        twice = np.frombuffer(sent.value, np.uint8)
        for pdf in batches:
            rows = [(d, k) for d, t in zip(pdf["d"], pdf["t"], strict=True) for k in set(line_keys(t, min_chars)[1]) if k]
            if rows:
                at = _bits(np.frombuffer(b"".join([_digest(k) for _, k in rows]), np.uint64).reshape(-1, 2), bits, hashes)
                hit = ((twice[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)
                some = [rows[i] for i in np.flatnonzero(hit)]
                if some:
                    yield pd.DataFrame({"d": pd.Series([d for d, _ in some], dtype="int64"), "key": [k.decode("utf-8", "surrogatepass") for _, k in some]})

    ids = docs.select(F.coalesce(F.col(doc_id), F.lit(-1)).cast("long").alias("d"), F.col(text).alias("t"))
    found = ids.mapInPandas(suspects, "d long, key string")
    counted = found.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("d").alias("first_doc"))
    return counted.filter(F.col("n_docs") >= min_docs)


def drop_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", text: str = "text", doc_id: str = "doc_id",
    max_filter_bits: int = 1 << 28, max_broadcast_keys: int = 1_000_000,
) -> DataFrame:
    """All columns of ``docs``, the text without repeated lines, and ``n_lines`` and ``n_dropped``.

    A key in at least ``min_docs`` documents loses all its lines (``keep="none"``) or all but the first
    in the smallest doc_id (``keep="first"``).  Columns of ``docs`` named like the two counts give way to them.
    """
    docs = without(docs, "n_lines", "n_dropped")
    if keep not in ("none", "first"):
        raise ValueError(keep)
    spark = docs.sparkSession
    found = materialize(repeated_lines(docs, min_docs, min_chars, text, doc_id, max_filter_bits), "lines")
    n = found.count()
    if n > max_broadcast_keys:
        return _drop_by_join(docs, found, min_chars, keep, text, doc_id)
    digests = found.select(F.md5(F.col("key").cast("binary")).alias("d"), "first_doc")  # their digests come, not the lines
    firsts = {bytes.fromhex(r["d"]): r["first_doc"] for r in digests.toLocalIterator()}
    sent = spark.sparkContext.broadcast(firsts)

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def dropped(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(texts, ids, strict=True):
            lines, keys = line_keys(t, min_chars)
            seen: set[bytes] = set()
            left = []
            for line, key in zip(lines, keys, strict=True):
                x = _digest(key) if key else b""
                if x in sent.value and not (keep == "first" and sent.value[x] == d and x not in seen):
                    continue
                seen.add(x)
                left.append(line)
            out.append((b"\n".join(left).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(left)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    done = docs.withColumn("__lines", dropped(F.col(text), F.coalesce(F.col(doc_id), F.lit(-1)).cast("long")))
    return done.select(*[F.col("__lines.text").alias(c) if c == text else F.col(c) for c in docs.columns], "__lines.n_lines", "__lines.n_dropped")


def _drop_by_join(docs: DataFrame, found: DataFrame, min_chars: int, keep: str, text: str, doc_id: str) -> DataFrame:
    """The way beyond the broadcast bound: lines meet the confirmed keys in a join (split by AQE where a key is hot)."""
    rows = docs.withColumn("__row", F.expr("uuid()"))
    rows = materialize(rows, "rows")
    lines = rows.select("__row", F.col(doc_id).alias("__doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("__at", "__line"))
    key = F.translate(F.btrim("__line", F.lit(" \t\n\x0b\x0c\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = lines.withColumn("key", key).join(found.select("key", "first_doc"), "key", "left")
    drop = F.col("first_doc").isNotNull() & (F.length("key") >= min_chars)
    flagged = joined.select("__row", "__doc", "key", "__at", "__line", "first_doc", drop.alias("__drop"))
    if keep == "first":
        first = flagged.filter(F.col("__drop") & (F.col("first_doc") == F.col("__doc"))).groupBy("__row", "key").agg(F.min("__at").alias("__first"))
        flagged = flagged.join(first, ["__row", "key"], "left").withColumn("__drop", F.col("__drop") & (F.coalesce(F.col("__first"), F.lit(-1)) != F.col("__at")))
    kept = F.array_sort(F.collect_list(F.when(~F.col("__drop"), F.struct("__at", "__line"))))
    back = flagged.groupBy("__row").agg(
        F.array_join(F.transform(kept, lambda x: x["__line"]), "\n").alias("__text"), F.count("*").alias("n_lines"), F.sum(F.col("__drop").cast("long")).alias("n_dropped")
    )
    return rows.join(back, "__row").select(*[F.col("__text").alias(c) if c == text else F.col(c) for c in docs.columns], "n_lines", "n_dropped")
