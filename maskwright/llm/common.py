"""Helpers shared by the training-data operators: shared scratch tables and packed exchanges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.plans.scratch import shared_dir  # noqa: F401
from maskwright.plans.scratch import written as materialize  # noqa: F401

#: bytes -> bytes: A-Z to a-z, everything that is not a word byte to a space.
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: The ASCII white space of the contracts, as bytes.split() and strip() also take it.
BLANKS = b" \t\n\x0b\x0c\r"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other scripts)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` less the columns (in any case) that an operator is about to add under these names."""
    taken = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in taken])


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by one pass over the column."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return int(row["b"] or 0)


def split_packed(keys: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Deal parallel arrays by ``key mod parts``: (part, [bytes of keys, bytes of each column]) for parts that get rows."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    sorted_columns = [c[order] for c in (keys, *columns)]
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), [c[bounds[p] : bounds[p + 1]].tobytes() for c in sorted_columns]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays (multiply and shift, wrapping)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))
