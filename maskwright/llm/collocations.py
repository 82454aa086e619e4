"""Phrases whose words stand together more often than their parts do apart, mined with weighted acyclic automata.

A count transducer reads a phrase word by word and gives how often it occurs.  Its states are kept level by level, each with the state it
is reached from, the word read and the count; words are numbered in byte order and states by path, so a level is sorted.

1. Each shard (a task's texts of one language, some millions of words at a time) builds its transducer from its sorted n-grams, level by level: the sorted
   (state, word) pairs of one level number the states of the next.  The transducer is cut by prefix range and sent as one packed value per range.
2. Each prefix range unites its cuts: states of equal paths become one, their weights are summed.  Then paths under ``min_count`` go; what a kept
   phrase's parts are looked up in later is kept too, for no part of a phrase is rarer than the phrase.
3. Composition: each range lists the parts of its phrases, once each, and sends them to the ranges that hold them; there they are
   read through the transducer, and the counts go back.  The same message tells a part how often the phrase around it occurs, which decides whether
   the part is dropped.
4. Each range scores its phrases and keeps its first ``top`` per language; a window over these gives the ranks.

A prefix range is a range of the 64-bit digest of the language and of a phrase's first two words (or only one): ranges are even without a sample, a common first word is spread
over all of them, and counts of a shard are summed before they are sent, so that a common pair, line or copy weighs no more than another.  No vocabulary, count table or list of phrases reaches the driver,
only the number of text bytes and of kept phrases, from which the ranges' number follows.

Defined results: a null text is empty and has no phrases; a null language counts as ``und``; repeated rows count each time; ids are not looked at; languages without a phrase over
``min_count`` give no row; an empty table gives an empty one; very long texts are read in stretches between separators, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, mix64, text_bytes

SHARD_WORDS = 2_000_000  #: words that a shard's transducer is built from
RANGE_BYTES = 16 << 20  #: of text that a prefix range stands for
RANGE_PHRASES = 100_000  #: kept phrases that a range holds once rare ones are gone
#: bytes -> bytes: A-Z to a-z, separators of pieces to a line feed, a tab to a space
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
STRETCH = 1 << 20  #: bytes of text that are split into words at once


# ---------------------------------------------------------------- transducers


@dataclass
class Transducer:
    """Weights of paths.  Level 0 has a state for each word; ``parents[k]`` are states of level k - 1, for k >= 1."""

    words: list[bytes]
    weights: list[np.ndarray]
    parents: list[np.ndarray | None]
    labels: list[np.ndarray | None]

    @property
    def depth(self) -> int:
        return len(self.weights)

    def keys(self, k: int) -> np.ndarray:
        return (self.parents[k] << 32) | self.labels[k]

    def paths(self, k: int) -> np.ndarray:
        """The word numbers of each path of level k, one row each."""
        if k == 0:
            return np.arange(len(self.words))[:, None]
        return np.concatenate([self.paths(k - 1)[self.parents[k]], self.labels[k][:, None]], 1)

    def states(self, paths: np.ndarray) -> np.ndarray:
        """The state that each path leads to, -1 for none; a path may hold -1 for a word that is not known."""
        at = paths[:, 0].copy()
        for k in range(1, paths.shape[1]):
            keys, wanted = self.keys(k), (at << 32) | paths[:, k]
            place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            found = (at >= 0) & (paths[:, k] >= 0) & (keys[place] == wanted if len(keys) else np.zeros(len(at), bool))
            at = np.where(found, place, -1)
        return at

    def compact(self) -> Transducer:
        """Without words that no path uses."""
        used = self.weights[0] > 0
        for k in range(1, self.depth):
            used[self.labels[k]] = True
        if self.depth > 1:
            used[self.parents[1]] = True
        number = np.cumsum(used) - 1
        at = np.flatnonzero(used)
        parents = [number[p] if k == 1 else p for k, p in enumerate(self.parents)]
        return Transducer([self.words[i] for i in at.tolist()], [self.weights[0][at], *self.weights[1:]], parents, [None, *(number[x] for x in self.labels[1:])])

    def at_least(self, count: int) -> Transducer:
        """Without paths of a smaller weight.  A path weighs no more than those it begins with."""
        weights, parents, labels = [np.where(self.weights[0] >= count, self.weights[0], 0)], [None], [None]
        number = np.arange(len(self.words))
        for k in range(1, self.depth):
            keep = self.weights[k] >= count
            weights.append(self.weights[k][keep])
            parents.append(number[self.parents[k][keep]])
            labels.append(self.labels[k][keep])
            number = np.cumsum(keep) - 1
        return Transducer(self.words, weights, parents, labels).compact()

    def packed(self) -> bytes:
        steps = [np.diff(p, prepend=0) for p in self.parents[1:]]
        return pack(self.words, [*self.weights, *steps, *self.labels[1:]])

    @staticmethod
    def unpacked(data: bytes) -> Transducer:
        words, arrays = unpack(data)
        n = (len(arrays) + 2) // 3
        return Transducer(words, arrays[:n], [None, *(np.cumsum(x) for x in arrays[n : 2 * n - 1])], [None, *arrays[2 * n - 1 :]])


def pack(words: list[bytes], arrays: list[np.ndarray]) -> bytes:
    """Words (without line feeds) and arrays of numbers from 0 on, each in the fewest bytes its largest needs."""
    small = [a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for a in arrays]
    text = b"\n".join(words)
    head = np.array([len(text), len(words), len(small), *(x for a in small for x in (len(a), a.itemsize))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(head).to_bytes(8, "little"), head.tobytes(), text, *(a.tobytes() for a in small)]))


def unpack(data: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, np.int64, n, 8).tolist()
    at = 8 + 8 * n
    words = raw[at : at + head[0]].split(b"\n") if head[1] else []
    at, arrays = at + head[0], []
    for length, size in zip(head[3::2], head[4::2], strict=True):
        arrays.append(np.frombuffer(raw, f"u{size}", length, at).astype(np.int64))
        at += length * size
    return words, arrays


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their summed weights, and the place of each key among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[starts], np.add.reduceat(weights[order], starts) if len(starts) else np.zeros(0, np.int64), place


def built(ids: np.ndarray, words: list[bytes], depth: int) -> Transducer:
    """The transducer of all phrases of at most ``depth`` words of a sequence: word numbers from 1 on, 0 between pieces."""
    by_bytes = sorted(range(len(words)), key=words.__getitem__)
    number = np.full(len(words) + 1, -1, np.int64)
    number[np.array(by_bytes, np.int64) + 1] = np.arange(len(words))
    ids = number[ids]
    at = np.flatnonzero(ids >= 0)
    state = ids[at]
    weights, parents, labels = [np.bincount(state, minlength=len(words)).astype(np.int64)], [None], [None]
    for k in range(1, depth):
        inside = at + k < len(ids)
        at, state = at[inside], state[inside]
        after = ids[at + k]
        real = after >= 0
        at, state = at[real], state[real]
        keys, counts, state = _summed((state << 32) | after[real], np.ones(len(at), np.int64))
        weights.append(counts)
        parents.append(keys >> 32)
        labels.append(keys & 0xFFFFFFFF)
    return Transducer([words[i] for i in by_bytes], weights, parents, labels)


def united(some: list[Transducer]) -> Transducer:
    """One transducer of all paths, weights summed."""
    words = sorted(set().union(*(t.words for t in some)))
    index = {w: i for i, w in enumerate(words)}
    maps = [np.fromiter(map(index.__getitem__, t.words), np.int64, len(t.words)) for t in some]
    first = np.zeros(len(words), np.int64)
    for m, t in zip(maps, some, strict=True):
        first[m] += t.weights[0]
    weights, parents, labels, states = [first], [None], [None], maps
    for k in range(1, some[0].depth):
        keys = np.concatenate([(s[t.parents[k]] << 32) | m[t.labels[k]] for t, m, s in zip(some, maps, states, strict=True)])
        keys, sums, place = _summed(keys, np.concatenate([t.weights[k] for t in some]))
        states = np.split(place, np.cumsum([len(t.weights[k]) for t in some])[:-1])
        weights.append(sums)
        parents.append(keys >> 32)
        labels.append(keys & 0xFFFFFFFF)
    return Transducer(words, weights, parents, labels)


# ---------------------------------------------------------------- prefix ranges


def ranges_of(words: list[bytes], paths: np.ndarray, lang: str, ranges: int) -> np.ndarray:
    """The prefix range of each path (word numbers), by its first two words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    digest = mix64(h[paths[:, 0]] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1)))
    if paths.shape[1] > 1:
        digest = mix64(digest + h[paths[:, 1]] * np.uint64(3))
    return ((digest >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def cut(t: Transducer, lang: str, ranges: int) -> Iterator[tuple[int, Transducer]]:
    """The transducer's parts by prefix range.  A word whose own count lies elsewhere has the weight 0."""
    sorted_levels, bounds, place, owner = [], [], None, None
    for k in range(t.depth):
        owner = ranges_of(t.words, t.paths(k), lang, ranges) if k < 2 else owner[t.parents[k]]
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(ranges + 1))
        up = None if k == 0 else t.parents[k][order] if k == 1 else place[t.parents[k][order]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - edges[owner[order]]
        sorted_levels.append((order, up))
        bounds.append(edges)
    for p in np.flatnonzero(np.sum([np.diff(b) for b in bounds], axis=0)).tolist():
        span = [slice(b[p], b[p + 1]) for b in bounds]
        own, parents, labels, weights = sorted_levels[0][0][span[0]], [None], [None], [None]
        for k in range(1, t.depth):
            order, up = sorted_levels[k]
            at = order[span[k]]
            parents.append(up[span[k]])
            labels.append(t.labels[k][at])
            weights.append(t.weights[k][at])
        used = np.unique(np.concatenate([own, *(labels[1:]), *(parents[1:2])]))
        counts = np.zeros(len(used), np.int64)
        counts[np.searchsorted(used, own)] = t.weights[0][own]
        weights[0] = counts
        if t.depth > 1:
            parents[1] = np.searchsorted(used, parents[1])
        yield p, Transducer([t.words[i] for i in used.tolist()], weights, parents, [None, *(np.searchsorted(used, x) for x in labels[1:])])


# ---------------------------------------------------------------- shards


class _Numbers(dict):
    """Words to numbers from 1 on; a line feed is 0, an empty word -1."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self) - 1
        return value


def _stretches(data: bytes) -> Iterator[bytes]:
    """Translated text in stretches of about ``STRETCH`` bytes that end where a piece ends."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at + STRETCH)
        end = len(data) if end < 0 else end + 1
        yield data[at:end]
        at = end


class Shard:
    """The words of some texts of one language."""

    def __init__(self):
        self.numbers, self.ids, self.held, self.waiting, self.bytes = _Numbers(), [], 0, [], 0

    def add(self, text: str) -> None:
        self.waiting.append(text.encode("utf-8", "surrogatepass"))
        self.bytes += len(self.waiting[-1])
        if self.bytes >= STRETCH:
            self.read()

    def read(self) -> None:
        for data in _stretches(b"\n".join(self.waiting).translate(_PIECES) + b"\n"):
            words = data.replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            self.ids.append(ids[ids >= 0].astype(np.int32))
            self.held += len(self.ids[-1])
        self.waiting, self.bytes = [], 0

    def transducer(self, depth: int) -> Transducer:
        self.read()
        return built(np.concatenate(self.ids), list(self.numbers)[2:], depth)


def _united_shards(docs: DataFrame, depth: int, ranges: int, min_count: int) -> DataFrame:
    """p, lang, tokens, phrases, data: the transducer of each prefix range and language, without what is rarer than ``min_count``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards: dict[str, Shard] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang in list(shards):
                rows = [(p, lang, part.packed()) for p, part in cut(shards.pop(lang).transducer(depth), lang, ranges)]
                yield pd.DataFrame(rows, columns=["p", "lang", "data"])

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["t"], strict=True):
                if text:
                    shards.setdefault(lang, Shard()).add(text)
                    if sum(s.held for s in shards.values()) >= SHARD_WORDS:
                        yield from flush()
        yield from flush()

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for lang, own in pdf.groupby("lang"):
            t = _all(own["data"])
            kept = t.at_least(min_count)
            rows.append((pdf["p"].iloc[0], lang, int(t.weights[0].sum()), sum(map(len, kept.weights)), kept.packed()))
        return pd.DataFrame(rows, columns=["p", "lang", "tokens", "phrases", "data"])

    parts = docs.mapInPandas(count, "p long, lang string, data binary")
    return parts.groupBy("p").applyInPandas(unite, "p long, lang string, tokens long, phrases long, data binary")


def _all(blobs) -> Transducer:
    """The union of packed transducers, some at a time, so that memory is that of the result and a few cuts."""
    blobs = list(blobs)
    some = [united([Transducer.unpacked(b) for b in blobs[i : i + 16]]) for i in range(0, len(blobs), 16)]
    while len(some) > 1:
        some = [united(some[i : i + 16]) for i in range(0, len(some), 16)]
    return some[0]


# ---------------------------------------------------------------- composition


def _distinct(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the place of each row among them."""
    order = np.lexsort(paths.T[::-1])
    ordered = paths[order]
    fresh = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)]) if len(paths) else np.zeros(0, bool)
    place = np.empty(len(paths), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place


@dataclass
class Part:
    """The distinct parts of one length of a transducer's phrases."""

    paths: np.ndarray
    owner: np.ndarray  #: prefix range
    around: np.ndarray  #: the greatest weight of a phrase around it
    place: dict[tuple[int, int], np.ndarray]  #: (level of phrases, start) -> the part of each phrase that starts there


def parts_of(t: Transducer, lang: str, ranges: int) -> list[Part]:
    """The parts, by length from 1 on, that phrases of t are cut into or, from two words on, contain."""
    out, paths = [], [t.paths(k) for k in range(t.depth)]
    for m in range(1, t.depth):
        takes = [(k, s) for k in range(m, t.depth) for s in range(k - m + 2) if m > 1 or s in (0, k)]
        rows, place = _distinct(np.concatenate([paths[k][:, s : s + m] for k, s in takes]))
        split = dict(zip(takes, np.split(place, np.cumsum([len(paths[k]) for k, _ in takes])[:-1]), strict=True))
        around = np.zeros(len(rows), np.int64)
        for (k, _), at in split.items():
            np.maximum.at(around, at, t.weights[k])
        out.append(Part(rows, ranges_of(t.words, rows, lang, ranges), around, split))
    return out


def _messages(t: Transducer, lang: str, ranges: int) -> Iterator[tuple[int, bytes]]:
    """What a range asks each range: its parts that lie there, and the weights around them."""
    parts = parts_of(t, lang, ranges)
    for p in np.unique(np.concatenate([x.owner for x in parts])).tolist():
        at = [np.flatnonzero(x.owner == p) for x in parts]
        rows = [x.paths[i] for x, i in zip(parts, at, strict=True)]
        used = np.unique(np.concatenate([r.ravel() for r in rows]))
        numbers = [np.searchsorted(used, r).ravel() for r in rows]
        yield p, pack([t.words[i] for i in used.tolist()], [*numbers, *(x.around[i] for x, i in zip(parts, at, strict=True))])


def _answered(t: Transducer, messages: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The weights of each message's parts, and the greatest weight around each path of t."""
    index = {w: i for i, w in enumerate(t.words)}
    around, answers = [np.zeros(len(w), np.int64) for w in t.weights], []
    for data in messages:
        words, arrays = unpack(data)
        number = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
        n, weights = len(arrays) // 2, []
        for m in range(1, n + 1):
            at = t.states(number[arrays[m - 1]].reshape(-1, m)) if len(arrays[m - 1]) else np.zeros(0, np.int64)
            if (at < 0).any():
                raise ValueError("a phrase has a part that is not counted")
            weights.append(t.weights[m - 1][at])
            np.maximum.at(around[m - 1], at, arrays[n + m - 1])
        answers.append(pack([], weights))
    return answers, around


def _scored(t: Transducer, lang: str, ranges: int, answers: dict[int, bytes], around: list[np.ndarray], share: tuple[int, int], top: int) -> list[tuple]:
    """lang, phrase, a, l, r, score of the first phrases that no longer one covers."""
    parts, counts = parts_of(t, lang, ranges), []
    known = {p: unpack(b)[1] for p, b in answers.items()}
    for m, x in enumerate(parts):
        own = np.zeros(len(x.paths), np.int64)
        for p, arrays in known.items():
            own[x.owner == p] = arrays[m]
        counts.append(own)
    rows = []
    for k in range(1, t.depth):
        a = t.weights[k].astype(object)  # Python's numbers: products may pass 64 bits
        best = None
        for s in range(1, k + 1):
            left = counts[s - 1][parts[s - 1].place[k, 0]]
            right = counts[k - s][parts[k - s].place[k, s]]
            score = 2_000_000 * a // (left.astype(object) + right)
            if best is None:
                best = [score, left, right]
            else:
                less = (score < best[0]).astype(bool)
                best = [np.where(less, n, b) for n, b in zip((score, left, right), best, strict=True)]
        keep = np.ones(len(a), bool) if k + 1 == t.depth else ~(share[1] * around[k].astype(object) >= share[0] * a).astype(bool)
        for row, *numbers in zip(t.paths(k)[keep].tolist(), *(x[keep].tolist() for x in (a, *best)), strict=True):
            rows.append((-int(numbers[1]), -int(numbers[0]), b" ".join(t.words[i] for i in row), int(numbers[2]), int(numbers[3])))
    rows.sort()
    return [(lang, phrase.decode("utf-8", "surrogatepass"), -a, left, right, -score) for score, a, phrase, left, right in rows[:top]]


# ---------------------------------------------------------------- operator


def _power(n: float) -> int:
    """The least power of two that is no smaller."""
    return 1 << max(0, math.ceil(math.log2(n))) if n > 1 else 1


def mine(
    docs: DataFrame, longest: int = 4, min_count: int = 30, top: int = 2000, covered: tuple[int, int] = (80, 100), text: str = "text", lang: str = "lang", range_bytes: int = RANGE_BYTES, range_phrases: int = RANGE_PHRASES
) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a (its count), l and r (the counts of its parts), n (words of the
    language) and score.

    The score of a phrase cut after its first words is floor(2000000 * a / (l + r)); the lowest cut counts, ties to the first.  A phrase goes whose words stand in a longer one of
    ``min_count`` or more with den * f(longer) >= num * a, for ``covered`` (num, den).
    """
    if longest < 2 or min_count < 1:
        raise ValueError("phrases need two words and a count of one at least")
    base = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("t"))
    ranges = _power(text_bytes(base, "t") / range_bytes)
    counted = materialize(_united_shards(base, longest, ranges, min_count), "transducers")
    kept = counted.agg(F.sum("phrases")).first()[0] or 0
    few = min(ranges, _power(kept / range_phrases))

    def regroup(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf["q"].iloc[0], name, _all(own["data"]).packed()) for name, own in pdf.groupby("lang")]
        return pd.DataFrame(rows, columns=["q", "lang", "data"])

    numbered = counted.filter("phrases > 0").withColumn("q", F.expr(f"p div {ranges // few}"))  # both are powers of two, so this is the digest's coarser range
    held = materialize(numbered.groupBy("q").applyInPandas(regroup, "q long, lang string, data binary"), "ranges")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, name, data in zip(pdf["q"], pdf["lang"], pdf["data"], strict=True):
                rows = [(p, q, name, m) for p, m in _messages(Transducer.unpacked(data), name, few)]
                yield pd.DataFrame(rows, columns=["q", "source", "lang", "message"])

    def answer(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for q, name, data in zip(own["q"], own["lang"], own["data"], strict=True):
            mine = asked[asked["lang"] == name]
            answers, around = _answered(Transducer.unpacked(data), mine["message"].tolist())
            rows += [(s, q, name, x) for s, x in zip(mine["source"], answers, strict=True)]
            rows.append((q, -1, name, pack([], around)))
        return pd.DataFrame(rows, columns=["q", "source", "lang", "message"])

    def score(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, data in zip(own["lang"], own["data"], strict=True):
            mine = told[told["lang"] == name]
            answers = dict(zip(mine["source"], mine["message"], strict=True))
            around = unpack(answers.pop(-1))[1]
            rows += _scored(Transducer.unpacked(data), name, few, answers, around, covered, top)
        return pd.DataFrame(rows, columns=["lang", "phrase", "a", "l", "r", "score"])

    message = "q long, source long, lang string, message binary"
    asked = held.mapInPandas(ask, message)
    told = materialize(held.groupBy("q").cogroup(asked.groupBy("q")).applyInPandas(answer, message), "answers")
    found = held.groupBy("q").cogroup(told.groupBy("q")).applyInPandas(score, "lang string, phrase string, a long, l long, r long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = counted.groupBy("lang").agg(F.sum("tokens").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
