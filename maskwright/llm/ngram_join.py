"""Exact Jaccard self-join of word shingle sets, by partitioning the universe of shingles.

A shingle's hash deals it into one of m segments.  Two sets at or over the threshold differ in at most H shingles
(H depends on their sizes), so of H + 1 segments one at least is equal in both: sets are indexed by the digests of
their segments and only those that meet in one are compared.  Sizes fall into bands; a band fixes H and the scheme, and a set
is indexed under its own band and each lower one that can hold a partner.

How a band's H is spent is chosen by cost, from the number of documents in the band:

* segment subsets: H + 1 + e segments, of which any pair shares e + 1 at least, so each set may leave out its e emptiest
  segments - a rule on contents (size <= t), so that both sides of a pair leave out the same ones;
* one-deletion neighbourhoods: ceil((H + 1) / 2) segments, of which one differs in one shingle at most; a segment is
  indexed whole and without each of its shingles.

Candidates are verified exactly on the whole shingle sets (64-bit shingle hashes).  Equal sets are collapsed
first.  Within an index entry of up to ``ALL_PAIRS`` sets all pairs are verified; in larger ones the members are verified
against a pivot, and those still in different components are compared in blocks, each pair of blocks in a task that gives only
the links that join components: no link between components is lost, and a group of copies makes links in proportion to its size.
Hot entries are combined per task before the shuffle, so an entry that a third of the documents share reaches a reducer with one row per task.

Defined results: null and blank texts have no shingles and are linked with nothing; a text with fewer words than the shingle
length is one shingle; rows without an id are not linked and get no component; rows of one id are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, mix64, split_packed, tokens_of
from maskwright.llm.components import components

ALL_PAIRS = 32  #: index entries up to this size have all their pairs verified at once
BLOCK = 512  #: members of a large index entry that a task compares with as many others
BLOCK_BYTES = 8 << 20  #: of their sets
COMBINE = 256  #: sets of one index entry within one task from which they are combined there
ENTRIES = 400_000  #: index entries that a reducer's group is meant to hold
BROADCAST_IDS = 1_000_000  #: ids of 8 bytes that may be broadcast; beyond, joins shuffle


# ---------------------------------------------------------------- sets


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    tokens = tokens_of(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < size:
        return np.array([xxhash.xxh64_intdigest(b"\0".join(tokens), len(tokens))], np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = len(h) - size + 1
    out = mix64(h[:n])
    for k in range(1, size):
        out = mix64(out + h[k : n + k] * np.uint64(2 * k + 1))
    return np.unique(out)


# ---------------------------------------------------------------- schemes


@dataclass(frozen=True)
class Scheme:
    """How the sets of one size band are indexed."""

    low: int
    high: int
    errors: int  #: shingles two partners may differ in
    segments: int
    spare: int  #: segments that a set may leave out
    deletion: bool  #: one-deletion neighbourhoods instead of whole segments

    def signatures(self, size: float) -> float:
        return self.segments + size if self.deletion else float(self.segments)


def bands(largest: int, num: int, den: int) -> list[tuple[int, int]]:
    """Size bands: each reaches to (den / num) squared times its start."""
    out, low = [], 1
    while low <= largest:
        high = max(low, low * den * den // (num * num))
        out.append((low, high))
        low = high + 1
    return out


def _surplus(mean: float, spare: int) -> float:
    """E[X; X > spare] of a Poisson variable."""
    p, total = math.exp(-mean), 0.0
    for k in range(int(mean + 12 * math.sqrt(mean + 1)) + spare + 12):
        if k > spare:
            total += k * p
        p *= mean / (k + 1)
    return total


def allocate(low: int, high: int, documents: int, num: int, den: int) -> Scheme:
    """The cheapest scheme of a band: index entries, plus verifications of sets that meet by empty segments alone."""
    errors, size = high * (den - num) // num, (low + high) / 2
    if errors == 0:
        return Scheme(low, high, 0, 0, 0, False)
    best: tuple[float, Scheme] | None = None
    for extra in (0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6):
        spare = math.ceil(extra * (errors + 1))
        m = errors + 1 + spare
        chance = _surplus(m * math.exp(-size / m), spare) / m
        s = Scheme(low, high, errors, m, spare, False)
        cost = s.signatures(size) + 20 * m * chance * chance * documents
        if best is None or cost < best[0]:
            best = cost, s
    k = (errors + 2) // 2
    chance = math.exp(-size / k) * (1 + size / k)
    s = Scheme(low, high, errors, k, 0, True)
    if s.signatures(size) + 20 * k * chance * chance * documents < best[0]:
        return s
    return best[1]


def signatures(tokens: np.ndarray, number: int, scheme: Scheme) -> np.ndarray:
    """The index entries (64 bits each) of a set under a scheme."""
    m = scheme.segments
    seed = mix64(np.array([number + 1], np.uint64))[0]
    own = mix64(tokens ^ seed)
    segment = ((own >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    counts = np.bincount(segment, minlength=m)
    ends = np.cumsum(counts)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own[order], dtype=np.uint64)])
    sums = running[ends] - running[ends - counts]
    place = mix64(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
    if scheme.deletion:
        without = sums[segment] - own
        return np.concatenate([mix64(sums ^ place), mix64(without ^ place[segment])])
    most = np.searchsorted(np.cumsum(np.bincount(counts)), scheme.spare, side="right") - 1
    keep = counts > most
    return mix64(sums[keep] ^ place[keep])


class Index:
    """The schemes of all bands; which of them a size is indexed under."""

    def __init__(self, schemes: list[Scheme], num: int, den: int):
        self.schemes, self.num, self.den = schemes, num, den
        self.highs = np.array([s.high for s in schemes], np.int64)

    def of(self, size: int) -> range:
        least = -(-size * self.num // self.den)  # the smallest size of a partner
        return range(int(np.searchsorted(self.highs, least)), int(np.searchsorted(self.highs, size)) + 1)

    def entries(self, tokens: np.ndarray) -> np.ndarray:
        found = [signatures(tokens, b, self.schemes[b]) for b in self.of(len(tokens)) if self.schemes[b].errors]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- candidates


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def _combined(keys: np.ndarray, nodes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with hot keys cut down to their smallest node; (3, n) of what this left out: key, node, that smallest node."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    starts, lengths = _runs(keys)
    run = np.repeat(np.arange(len(starts)), lengths)
    hot = (lengths[run] > limit) & (np.arange(len(keys)) != starts[run])
    return keys[~hot], nodes[~hot], np.stack([keys[hot].view(np.int64), nodes[hot], nodes[starts[run[hot]]]])


def candidates_of(keys: np.ndarray, nodes: np.ndarray, all_pairs: int, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (n, 2) to verify, larger node first, and members (n, 2: key, node) of entries that need further rounds.

    ``marked`` entries have more nodes elsewhere and count as large, however few are here."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    same = np.concatenate([[False], (keys[1:] == keys[:-1]) & (nodes[1:] == nodes[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, nodes = keys[~same], nodes[~same]
    starts, lengths = _runs(keys)
    pairs, members = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    large = lengths > all_pairs
    if marked is not None:
        large |= np.isin(keys[starts], marked)
    for n in np.unique(lengths[(lengths > 1) & ~large]):
        some = nodes[starts[(lengths == n) & ~large][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        pairs.append(np.unique(np.stack([some[:, j].ravel(), some[:, i].ravel()], 1), axis=0))
    for s, n in zip(starts[large], lengths[large], strict=True):
        pairs.append(np.stack([nodes[s + 1 : s + n], np.full(n - 1, nodes[s])], 1))
        members.append(np.stack([keys[s : s + n].view(np.int64), nodes[s : s + n]], 1))
    return np.unique(np.concatenate(pairs), axis=0), np.concatenate(members)


def _candidates(docs: DataFrame, index: Index, size: int, parts: int, all_pairs: int, combine: int) -> DataFrame:
    """kind 0: pair (a, b) to verify; kind 1: member (a: entry, b: node) of an entry too large for all pairs."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, keys, nodes, held = Words(), [], [], 0

        def flush() -> pd.DataFrame:
            k = np.concatenate(keys)
            left, own, hot = _combined(k, np.repeat(np.array(nodes, np.int64), [len(x) for x in keys]), combine)
            rows = [(p, data[0], data[1], None, None) for p, data in split_packed(left, parts, own)]
            if hot.size:
                rows.append((int(left[0] % np.uint64(parts)), None, None, hot.tobytes(), None))
                # where other tasks' nodes of a hot entry are met, they must become members of it too
                rows += [(p, None, None, None, data[0]) for p, data in split_packed(np.unique(hot[0].view(np.uint64)), parts)]
            return pd.DataFrame(rows, columns=["p", "keys", "nodes", "hot", "marks"])

        for pdf in batches:
            for d, t in zip(pdf["d"].tolist(), pdf["t"], strict=True):
                found = index.entries(shingle_set(t, size, words))
                if len(found):
                    keys.append(found)
                    nodes.append(d)
                    held += len(found)
                if held > 1_000_000:
                    yield flush()
                    keys, nodes, held = [], [], 0
        if held:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = pdf[pdf["keys"].notna()]
        k = np.frombuffer(b"".join(packed["keys"]), np.uint64)
        marked = np.unique(np.frombuffer(b"".join(pdf["marks"].dropna()), np.uint64))
        pairs, members = candidates_of(k, np.frombuffer(b"".join(packed["nodes"]), np.int64), all_pairs, marked)
        for hot in pdf["hot"].dropna():
            x = np.frombuffer(hot, np.int64).reshape(3, -1)
            pairs = np.concatenate([pairs, np.stack([x[1], x[2]], 1)])
            members = np.concatenate([members, np.stack([x[0], x[1]], 1), np.stack([x[0], x[2]], 1)])
        pairs = np.unique(pairs, axis=0)
        both = np.concatenate([pairs, members])
        return pd.DataFrame({"kind": np.repeat(np.array([0, 1], np.int32), [len(pairs), len(members)]), "a": both[:, 0], "b": both[:, 1]})

    dealt = docs.mapInPandas(deal, "p int, keys binary, nodes binary, hot binary, marks binary")
    return dealt.groupBy("p").applyInPandas(meet, "kind int, a long, b long")


# ---------------------------------------------------------------- verification


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b| for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if den * len(small) < num * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles in each of 256 to 8192 bits, some bits for each shingle.

    Two sketches, the longer one folded, differ in at most as many bits as the sets in shingles.
    """
    bits = 1 << min(13, max(8, (2 * len(tokens)).bit_length()))
    counts = np.bincount((mix64(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A sketch (or rows of them) folded to so many 64-bit words."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _sketches(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, n, sketch of the nodes (d), which are a written table."""
    few = nodes.count() <= BROADCAST_IDS
    own = docs.join(F.broadcast(nodes) if few else nodes, "d", "left_semi").dropDuplicates(["d"]).select("d", "t")

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            sets = [shingle_set(t, size, words) for t in pdf["t"]]
            yield pd.DataFrame({"node": pdf["d"], "n": [len(x) for x in sets], "sketch": [sketch(x).tobytes() for x in sets]})

    return materialize(own.mapInPandas(drawn, "node long, n long, sketch binary"), "sketches")


def _near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches do not rule a link out."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            na, nb = pdf["na"].to_numpy(), pdf["nb"].to_numpy()
            good = den * np.minimum(na, nb) >= num * np.maximum(na, nb)
            words = np.minimum(pdf["sa"].str.len(), pdf["sb"].str.len()).to_numpy() // 8
            for w in np.unique(words[good]):
                at = np.flatnonzero(good & (words == w))
                x, y = (np.stack([folded(np.frombuffer(v, np.uint64), w) for v in pdf[c].iloc[at]]) for c in ("sa", "sb"))
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                good[at] = apart * (den + num) <= (den - num) * (na[at] + nb[at])
            yield pdf.loc[good, ["a", "b"]]

    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInPandas(kept, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar.  Sketches of sets travel first, then only the texts of pairs that these leave."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), "nodes")
    pairs = materialize(_near(pairs, _sketches(docs, ids, size), num, den), "near")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), "nodes")
    few = ids.count() <= BROADCAST_IDS
    texts = materialize(docs.join(F.broadcast(ids) if few else ids, "d", "left_semi").dropDuplicates(["d"]), "texts")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, last, own = Words(), None, np.zeros(0, np.uint64)
        for pdf in batches:
            good = []
            for a, b, ta, tb in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["ta"], pdf["tb"], strict=True):
                if b != last:
                    last, own = b, shingle_set(tb, size, words)
                good.append(similar(shingle_set(ta, size, words), own, num, den))
            yield pdf.loc[good, ["a", "b"]]

    left = pairs.join(texts.select(F.col("d").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(texts.select(F.col("d").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long")


class Roots(dict):
    """Union-find over numbers."""

    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def close_nodes(sketches: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rows that may be linked with a row of another component, among pairs of ``left`` and ``right`` rows."""
    words = min(len(x) for x in sketches)
    maps = np.stack([folded(x, words) for x in sketches])
    close = np.zeros(len(sizes), bool)
    for i in left:
        apart = np.bitwise_count(maps[right] ^ maps[i]).sum(1, dtype=np.int64)
        good = (apart * (den + num) <= (den - num) * (sizes[right] + sizes[i])) & (labels[right] != labels[i])
        close[right[good]] = True
        close[i] |= good.any()
    return close


def links_between(sets: list[np.ndarray], nodes: list[int], labels: list[int], left: list[int], right: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components, among pairs of ``left`` and ``right`` rows; pairs that are connected by then are passed over."""
    roots, out = Roots(), []
    drawn = [sketch(x) for x in sets]
    words = min(map(len, drawn))
    maps, sizes = np.stack([folded(x, words) for x in drawn]), np.array([len(x) for x in sets])
    others = np.array(right, np.int64)
    for i in left:
        apart = np.bitwise_count(maps[others] ^ maps[i]).sum(1, dtype=np.int64)
        for j in others[apart * (den + num) <= (den - num) * (sizes[others] + sizes[i])].tolist():
            if roots.find(labels[i]) != roots.find(labels[j]) and similar(sets[i], sets[j], num, den):
                roots.join(labels[i], labels[j])
                out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
    return out


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    own, i, j = pdf["own"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def _linked(found: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(node, component) from candidates and the members of large entries."""
    links = materialize(_verified(materialize(found.filter("kind = 0").select("a", "b").distinct(), "pairs"), docs, size, num, den), "links")
    labels = materialize(components(links), "labels")
    members = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node")).distinct()
    if members.isEmpty():
        return labels
    # Large entries whose members are in several components by now: blocks of members are compared with each other in tasks.
    labelled = materialize(members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "members")
    entries = labelled.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g")
    )
    entries = entries.filter("x <> y").groupBy("n", "h", "g").agg(F.min("key").alias("key")).select("key", "n")  # entries of the same members count once
    rest = materialize(labelled.join(entries, "key"), "rest")
    sketches = _sketches(docs, materialize(rest.select(F.col("node").alias("d")).distinct(), "nodes"), size)

    def dealt(rows: DataFrame, blocks: Column) -> DataFrame:
        """Each row to all pairs of its block of its entry with others."""
        out = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return out.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")

    def rule_out(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        maps = [np.frombuffer(x, np.uint64) for x in pdf["sketch"]]
        return pdf.loc[close_nodes(maps, pdf["n"].to_numpy(), pdf["component"].to_numpy(), left, right, num, den), ["key", "node", "component"]]

    first = dealt(rest, F.ceil(F.col("n") / BLOCK)).join(sketches, "node")
    close = first.groupBy("key", "i", "j").applyInPandas(rule_out, "key long, node long, component long").distinct()
    close = materialize(close, "close")
    ids = materialize(close.select(F.col("node").alias("d")).distinct(), "nodes")
    few = ids.count() <= BROADCAST_IDS

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["d"], "tokens": [shingle_set(t, size, words).tobytes() for t in pdf["t"]]})

    some = docs.join(F.broadcast(ids) if few else ids, "d", "left_semi").dropDuplicates(["d"]).select("d", "t")
    sets = materialize(some.mapInPandas(packed, "node long, tokens binary"), "packed")
    sized = close.join(sets.select("node", F.length("tokens").alias("bytes")), "node")
    blocks = sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("many"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        out = links_between([np.frombuffer(x, np.uint64) for x in pdf["tokens"]], pdf["node"].tolist(), pdf["component"].tolist(), left.tolist(), right.tolist(), num, den)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    more = dealt(close.join(blocks, "key"), F.col("many")).join(sets, "node").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return materialize(components(known.unionByName(materialize(more, "links"))), "labels")


# ---------------------------------------------------------------- operator


def similar_groups(
    docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100), text: str = "text", doc_id: str = "doc_id", all_pairs: int = ALL_PAIRS, combine: int = COMBINE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id (the smallest id reachable by links).

    ``threshold`` is a fraction (num, den): sets link when den * |intersection| >= num * |union|.
    """
    num, den = threshold
    absent = F.lit(-(1 << 63))  # stands for a null id: Arrow would turn the column into floats
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), absent).alias("d"), F.col(text).cast("string").alias("t"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            sets = [shingle_set(t, shingle, words) for t in pdf["t"]]
            yield pd.DataFrame({"d": pdf["d"], "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]})

    rows = materialize(base.mapInPandas(digests, "d long, n long, digest binary"), "sets")
    real = rows.filter((F.col("n") > 0) & (F.col("d") != absent))
    classes = materialize(real.groupBy("digest").agg(F.min("d").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")
    largest = classes.agg(F.max("n")).first()[0] or 1
    limits = bands(int(largest), num, den)
    # one row per band, a few dozen for any corpus
    number = F.array_size(F.filter(F.array(*[F.lit(low) for low, _ in limits]), lambda low: low <= F.col("n"))) - 1
    sizes = {r["band"]: r["count"] for r in classes.groupBy(number.alias("band")).count().collect()}
    index = Index([allocate(low, high, sizes.get(i, 0) + sizes.get(i + 1, 0), num, den) for i, (low, high) in enumerate(limits)], num, den)
    expected = sum(n * sum(index.schemes[b].signatures(limits[i][1]) for b in index.of(limits[i][1])) for i, n in sizes.items() if i >= 0)
    parts = max(1, math.ceil(expected / ENTRIES))
    copies = materialize(real.join(classes.filter("copies > 1").select("digest", "rep"), "digest").filter("d <> rep").select("d"), "copies")
    few = copies.count() <= BROADCAST_IDS
    single = base.filter(F.col("d") != absent).join(F.broadcast(copies) if few else copies, "d", "left_anti")
    found = materialize(_candidates(single, index, shingle, parts, all_pairs, combine), "candidates")
    labels = _linked(found, base.filter(F.col("d") != absent), shingle, num, den)
    final = classes.join(labels, classes["rep"] == labels["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(final, "digest", "left")
    own = F.nullif(F.col("d"), absent)
    group = F.when(own.isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(own)
    return out.select(own.alias(doc_id), F.col("n").alias("n_shingles"), group.alias("component_id"))
