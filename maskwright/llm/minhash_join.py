"""Near-duplicates by an inverted join over MinHash signatures.

Each distinct shingle set gets a signature of ``coordinates`` minima.  A document is posted under its (coordinate, value) pairs;
two documents collide in as many pairs as their signatures agree in, and only pairs that collide at least ``matches`` times are kept.

Prefix and skip: with k coordinates and t matches asked for, two documents that reach t share at least one of the k - t + 1 first pairs of
each, in any order that is the same for all.  Pairs are ordered from the rarest to the commonest, so each document is posted under its k - t + 1
rarest pairs, and its t - 1 commonest postings - those of passages that many documents hold - are skipped when lists are merged.  What was
skipped is counted afterwards from a byte of each coordinate, which travels with a posting; a byte can only make the count too high.
How common a pair is comes from a count sketch over all documents: 2 MB whatever the corpus holds; an error there changes the order, not the result.

``matches`` follows from the threshold and ``miss``, the chance that two documents just at the threshold collide less often (``least_matches``).
Kept pairs are verified on their whole shingle sets; lists of more than ``ngram_join.ALL_PAIRS`` documents are compared with a pivot, and those still
apart in blocks, as the n-gram join does it.  Equal sets are one class from the start.

Defined results: null and blank texts have no shingles, are linked with nothing and kept; a text with fewer words than the shingle length is one
shingle; rows without an id are kept and have no component; rows of one id are one node; an empty table gives an empty one; texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import ngram_join
from maskwright.llm.common import materialize, mix64, split_packed
from maskwright.llm.ngram_join import ALL_PAIRS, COMBINE, Words, shingle_set

COORDINATES = 32
MISS = 1e-7
COUNTERS = 1 << 18  #: of the sketch that says how common a pair is
SLICES = 64
POSTINGS = 200_000  #: postings that a reducer's group is meant to hold


def least_matches(coordinates: int, num: int, den: int, miss: float = MISS) -> int:
    """The largest t for which documents of similarity num / den collide fewer than t times with a chance of at most ``miss``."""
    j, below = num / den, 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * j**t * (1 - j) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def signature(tokens: np.ndarray, coordinates: int) -> np.ndarray:
    """The (coordinate, value) pairs of a set, 64 bits each."""
    number = np.arange(1, coordinates + 1, dtype=np.uint64)
    seeds = mix64(number * np.uint64(0x9E3779B97F4A7C15))
    odd = mix64(seeds) | np.uint64(1)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(tokens), 2048):
        np.minimum(least, ((tokens[s : s + 2048, None] ^ seeds) * odd).min(0), out=least)
    return mix64(least + number * np.uint64(0x9E3779B97F4A7C15))


def prefixes(pairs: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` rarest pairs of each row; ties by the pair itself."""
    order = np.lexsort((pairs, counts[pairs // np.uint64((1 << 64) // COUNTERS)]), axis=1)
    return np.take_along_axis(pairs, order[:, :length], axis=1)


def _collide(marks: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, matches: int, num: int, den: int) -> np.ndarray:
    """Which of the row pairs (a, b) collide often enough and are near enough in size."""
    good = den * np.minimum(sizes[a], sizes[b]) >= num * np.maximum(sizes[a], sizes[b])
    for s in range(0, len(a), 100_000):
        e = slice(s, s + 100_000)
        good[e] &= (marks[a[e]] == marks[b[e]]).sum(1) >= matches
    return good


def merged(keys: np.ndarray, nodes: np.ndarray, marks: np.ndarray, sizes: np.ndarray, matches: int, num: int, den: int, all_pairs: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (n, 2; larger node first) of the postings that reach ``matches``, and members (n, 2: key, node) of lists that need further rounds.

    ``marked`` lists have more members elsewhere and count as large, however few are here."""
    order = np.lexsort((nodes, keys))
    same = np.concatenate([[False], (np.diff(keys[order]) == 0) & (np.diff(nodes[order]) == 0)]) if len(keys) else np.zeros(0, bool)
    order = order[~same]
    keys, nodes, marks, sizes = keys[order], nodes[order], marks[order], sizes[order]
    starts, lengths = ngram_join._runs(keys)
    large = (lengths > all_pairs) | np.isin(keys[starts], marked)
    left, right, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    for n in np.unique(lengths[(lengths > 1) & ~large]):
        rows = starts[(lengths == n) & ~large][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        left.append(rows[:, j].ravel())
        right.append(rows[:, i].ravel())
    for s, n in zip(starts[large], lengths[large], strict=True):
        left.append(np.arange(s + 1, s + n))
        right.append(np.full(n - 1, s))
        members.append(np.stack([keys[s : s + n].view(np.int64), nodes[s : s + n]], 1))
    a, b = np.concatenate(left), np.concatenate(right)
    good = _collide(marks, sizes, a, b, matches, num, den)
    return np.unique(np.stack([nodes[a[good]], nodes[b[good]]], 1), axis=0), np.concatenate(members)


def _commonness(classes: DataFrame) -> np.ndarray:
    """How often each of ``COUNTERS`` groups of pairs occurs: one row for each slice reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for pdf in batches:
            pairs = np.frombuffer(b"".join(pdf["sig"]), np.uint64)
            total += np.bincount((pairs // np.uint64((1 << 64) // COUNTERS)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            yield pd.DataFrame({"slice": range(SLICES), "counts": [x.tobytes() for x in np.split(total, SLICES)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS // SLICES, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [total.tobytes()]})

    schema = "slice int, counts binary"
    rows = classes.select("sig").mapInPandas(count, schema).groupBy("slice").applyInPandas(add, schema).collect()
    out = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def _candidates(classes: DataFrame, coordinates: int, matches: int, num: int, den: int, parts: int, all_pairs: int, combine: int) -> DataFrame:
    """kind 0: pair (a, b) to verify; kind 1: member (a: list, b: node) of a list too long for all pairs."""
    counts = classes.sparkSession.sparkContext.broadcast(_commonness(classes))
    length = coordinates - matches + 1

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = np.frombuffer(b"".join(pdf["sig"]), np.uint64).reshape(-1, coordinates)
            for s in range(0, len(pairs), 20_000):
                own = pairs[s : s + 20_000]
                keys = prefixes(own, counts.value, length).ravel()
                row = np.repeat(np.arange(len(own)), length)
                nodes, sizes = pdf["rep"].to_numpy()[s : s + 20_000], pdf["n"].to_numpy()[s : s + 20_000]
                marks = (own & np.uint64(255)).astype(np.uint8)
                # a list that is long within this task alone keeps its smallest node; the others meet that one here
                order = np.lexsort((nodes[row], keys))
                keys, row = keys[order], row[order]
                starts, lengths = ngram_join._runs(keys)
                run = np.repeat(np.arange(len(starts)), lengths)
                hot = (lengths[run] > combine) & (np.arange(len(keys)) != starts[run])
                first, rest, key = row[starts[run[hot]]], row[hot], keys[hot]
                keys, row = keys[~hot], row[~hot]
                width = np.dtype((np.void, coordinates))
                posted = split_packed(keys, parts, nodes[row], np.ascontiguousarray(marks[row]).view(width).ravel(), sizes[row])
                rows = [(p, *data, None, None) for p, data in posted]
                if len(key):
                    good = _collide(marks, sizes, rest, first, matches, num, den)
                    found = np.concatenate([np.stack([np.zeros(good.sum(), np.int64), nodes[rest[good]], nodes[first[good]]], 1)]
                        + [np.stack([np.ones(len(key), np.int64), key.view(np.int64), nodes[x]], 1) for x in (rest, first)])
                    rows.append((int(key[0] % np.uint64(parts)), None, None, None, None, found.tobytes(), None))
                    # where other tasks' nodes of such a list are met, they must become members of it too
                    rows += [(p, None, None, None, None, None, data[0]) for p, data in split_packed(np.unique(key), parts)]
                yield pd.DataFrame(rows, columns=["p", "keys", "nodes", "bytes", "sizes", "found", "lists"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        joined = lambda c, kind: np.frombuffer(b"".join(pdf[c].dropna()), kind)
        marks = joined("bytes", np.uint8).reshape(-1, coordinates)
        pairs, members = merged(joined("keys", np.uint64), joined("nodes", np.int64), marks, joined("sizes", np.int64), matches, num, den, all_pairs, np.unique(joined("lists", np.uint64)))
        both = np.concatenate([np.pad(pairs, ((0, 0), (1, 0))), np.pad(members, ((0, 0), (1, 0)), constant_values=1), joined("found", np.int64).reshape(-1, 3)])
        both = np.unique(both, axis=0)
        return pd.DataFrame({"kind": both[:, 0].astype(np.int32), "a": both[:, 1], "b": both[:, 2]})

    dealt = classes.select("rep", "n", "sig").mapInPandas(post, "p int, keys binary, nodes binary, bytes binary, sizes binary, found binary, lists binary")
    return dealt.groupBy("p").applyInPandas(meet, "kind int, a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    threshold: tuple[int, int] = (80, 100),
    coordinates: int = COORDINATES,
    miss: float = MISS,
    text: str = "text",
    doc_id: str = "doc_id",
    all_pairs: int = ALL_PAIRS,
    combine: int = COMBINE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links) and kept.

    Sets link when den * |intersection| >= num * |union| of the ``threshold`` (num, den).
    """
    num, den = threshold
    matches = least_matches(coordinates, num, den, miss)
    absent = F.lit(-(1 << 63))  # stands for a null id: Arrow would turn the column into floats
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), absent).alias("d"), F.col(text).cast("string").alias("t"))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            sets = [shingle_set(t, shingle, words) for t in pdf["t"]]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pd.DataFrame({"d": pdf["d"], "n": [len(s) for s in sets], "digest": digests, "sig": [signature(s, coordinates).tobytes() if len(s) else None for s in sets]})

    rows = materialize(base.mapInPandas(signed, "d long, n long, digest binary, sig binary"), "signatures")
    real = rows.filter((F.col("n") > 0) & (F.col("d") != absent))
    classes = materialize(real.groupBy("digest").agg(F.min("d").alias("rep"), F.max("n").alias("n"), F.first("sig").alias("sig")), "classes")
    parts = max(1, math.ceil(classes.count() * (coordinates - matches + 1) / POSTINGS))
    found = materialize(_candidates(classes, coordinates, matches, num, den, parts, all_pairs, combine), "candidates")
    labels = ngram_join._linked(found, base.filter(F.col("d") != absent), shingle, num, den)
    final = classes.join(labels, classes["rep"] == labels["node"], "left").select("digest", F.coalesce("component", "rep").alias("c"))
    out = rows.drop("sig").join(final, "digest", "left")
    own = F.nullif(F.col("d"), absent)
    group = F.when(own.isNotNull() & (F.col("n") > 0), F.col("c")).otherwise(own)
    return out.select(own.alias(doc_id), F.col("n").alias("n_shingles"), group.alias("component_id"), (own.isNull() | (own == group)).alias("kept"))
