"""Toxicity scores from a small bidirectional gated recurrent network over characters and words.

A word enters the network as a learned vector (frequent training words) beside the final states of
a bidirectional gated network over its bytes, so that unseen word forms are judged by their spelling.
A second bidirectional network reads windows of words, attention pools its states, and a logistic
unit gives the window's score.  Windows overlap by a quarter; every window of every text is scored, and
the largest score is the document's.

The network is trained here, in numpy, on a sample of labelled rows whose bound is a parameter
(``TrainConfig.max_per_class`` and ``max_clean``); labels say nothing about windows, so training starts with the windows that hold words, or spellings, which
tell toxic documents beyond chance, and later alternates between picking the windows that explain a toxic document best (and the clean windows most like
toxic ones) and gradient steps on them.  Scoring is one Arrow pass without a shuffle.

Defined results: null and empty texts have no window and get the score ``Model.empty_score``
(at most 0.49, the training sample's share of toxic rows otherwise).  Repeated rows are scored each.  Very long texts are scored window by window, whole.
Empty tables give empty ones; without labelled rows of both classes the model is a constant.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, without, words_of

PIECE = 20  #: bytes of a word that one token holds; longer words become several tokens


@dataclass(frozen=True)
class TrainConfig:
    """Bounds and sizes of training; none of them limits what is scored."""

    max_per_class: int = 1500  #: toxic rows
    max_clean: int = 4000  #: rows that are not
    window: int = 32
    stride: int = 24
    vocabulary: int = 4096
    min_count: int = 4
    char_dim: int = 12
    char_hidden: int = 16
    word_dim: int = 8
    hidden: int = 8
    epochs: int = 8
    batch: int = 256
    steps: int = 120  #: of an epoch at least, while batches have 16 windows
    averaged: int = 2  #: last epochs over whose steps the weights are averaged: single steps sway with the sample's order
    spelled: float = 0.5  #: share of a batch's words that are read by their spelling alone
    doubt: float = 0.05  #: score under which a toxic document's best window is taken for a clean one
    rate: float = 0.008
    seed: int = 7


@dataclass
class Model:
    config: TrainConfig
    vocabulary: dict[bytes, int]
    weights: dict[str, np.ndarray]
    empty_score: float = 0.0
    constant: bool = False
    cache: dict[bytes, int] = field(default_factory=dict)


def pieces_of(text: str | None) -> list[bytes]:
    """The tokens the network reads: words, those over ``PIECE`` bytes cut into several; nothing is left out."""
    out = words_of(text)
    if any(len(w) > PIECE for w in out):
        out = [w[i : i + PIECE] for w in out for i in range(0, len(w), PIECE)]
    return out


# ---------------------------------------------------------------- network
# Gates and states use the softsign x / (1 + |x|), moved to 0..1 for gates: its cost is a few plain operations.


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (np.abs(x) + np.float32(1))


def _slope(s: np.ndarray) -> np.ndarray:
    """The softsign's derivative from its value."""
    a = np.float32(1) - np.abs(s)
    return a * a


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gru(table: np.ndarray, at: np.ndarray, u: np.ndarray, active: list[int] | None, saved: list | None) -> np.ndarray:
    """States (T, B, H) over rows ``at`` (T, B) of projected inputs ``table`` (., 3H) for update gates, reset gates and candidates.

    ``active``: how many of the B sequences (longest first) still run at each step; the others keep their state.
    """
    steps, batch = at.shape
    n = u.shape[0]
    states = np.empty((steps, batch, n), np.float32)
    h = np.zeros((batch, n), np.float32)
    for t in range(steps):
        k = batch if active is None else active[t]
        x, old = table.take(at[t, :k], 0), h[:k]
        hu = old @ u
        g = _soft(x[:, : 2 * n] + hu[:, : 2 * n])
        g += np.float32(1)
        g *= np.float32(0.5)
        z, r, hc = g[:, :n], g[:, n:], hu[:, 2 * n :]
        c = _soft(x[:, 2 * n :] + r * hc)
        if saved is not None:
            saved.append((old, hc, z, r, c))
        now = states[t]
        np.subtract(old, c, out=now[:k])
        now[:k] *= z
        now[:k] += c
        if k < batch:
            now[k:] = h[k:]
        h = now
    return states


def _gru_back(d_states: np.ndarray, saved: list, u: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of each step's projected inputs and of the recurrent matrix."""
    steps, batch, n = d_states.shape
    dxp: list[np.ndarray] = [None] * steps  # type: ignore[list-item]
    du, dh = np.zeros_like(u), np.zeros((batch, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, hc, z, r, c = saved[t]
        k = len(h)
        dh += d_states[t]
        d = dh[:k]
        dc = d * (1 - z) * _slope(c)
        dz = d * (h - c) * np.float32(0.5) * _slope(2 * z - 1)
        dr = dc * hc * np.float32(0.5) * _slope(2 * r - 1)
        dxp[t] = np.concatenate([dz, dr, dc], 1)
        dhu = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ dhu
        dh[:k] = d * z + dhu @ u.T
    return dxp, du


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by ``index`` below n."""
    order = np.argsort(index, kind="stable")
    used, first = np.unique(index[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[used] = np.add.reduceat(rows[order], first, 0)
    return out


def initial_weights(c: TrainConfig, words: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(c.seed)

    def w(*shape: int, scale: float | None = None) -> np.ndarray:
        return (rng.standard_normal(shape) * (scale or 1.5 / np.sqrt(shape[0]))).astype(np.float32)

    x = c.word_dim + 2 * c.char_hidden
    out = {"chars": w(256, c.char_dim, scale=0.7), "words": w(words + 1, c.word_dim, scale=0.1)}
    for side in "fb":
        out |= {
            f"cw{side}": w(c.char_dim, 3 * c.char_hidden), f"cu{side}": w(c.char_hidden, 3 * c.char_hidden), f"cb{side}": np.zeros(3 * c.char_hidden, np.float32),
            f"ww{side}": w(x, 3 * c.hidden), f"wu{side}": w(c.hidden, 3 * c.hidden), f"wb{side}": np.zeros(3 * c.hidden, np.float32),
        }
    out |= {
        "aw": w(2 * c.hidden, c.hidden), "ab": np.zeros(c.hidden, np.float32), "av": w(c.hidden, scale=1.0),
        "ow": w(2 * c.hidden, scale=1.0), "ob": np.full(1, -1, np.float32),
    }
    out["words"][0] = 0
    return out


def byte_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Longest first: the order, bytes from the front and from the end as (longest, n), and how many tokens reach each place."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    width = int(lengths[0])
    raw = np.frombuffer(b"".join([tokens[i].ljust(width, b"\0") for i in order]), np.uint8).reshape(-1, width)
    place = np.arange(width)[:, None]
    back = raw[np.arange(len(tokens)), np.maximum(lengths - 1 - place, 0)]
    return order, raw.T, back, [int(k) for k in (place < lengths).sum(1)]


def _vectors(m: dict[str, np.ndarray], ids: np.ndarray, tokens: list[bytes], saved: dict | None) -> np.ndarray:
    """Inputs of the word network for distinct tokens: word vector and the byte network's two final states."""
    order, front, back, active = byte_table(tokens)
    ends = []
    for side, at in (("f", front), ("b", back)):
        steps: list | None = None if saved is None else []
        states = _gru(m["chars"] @ m[f"cw{side}"] + m[f"cb{side}"], at, m[f"cu{side}"], active, steps)
        end = np.empty_like(states[-1])
        end[order] = states[-1]
        ends.append(end)
        if saved is not None:
            saved[side] = (at, steps)
    if saved is not None:
        saved |= {"order": order, "active": active}
    return np.concatenate([m["words"][ids], *ends], 1)


def _projected(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.concatenate([x @ m["wwf"] + m["wbf"], x @ m["wwb"] + m["wbb"]], 1)


def _windows(m: dict[str, np.ndarray], forth: np.ndarray, back: np.ndarray, rows: np.ndarray, saved: dict | None) -> np.ndarray:
    """Logits of windows.  forth, back: projected distinct tokens; rows: (T, B) of them."""
    steps: dict[str, list | None] = {s: None if saved is None else [] for s in "fb"}
    h = np.concatenate([_gru(forth, rows, m["wuf"], None, steps["f"]), _gru(back, rows[::-1], m["wub"], None, steps["b"])[::-1]], 2)
    flat = h.reshape(-1, h.shape[2])
    u = _soft(flat @ m["aw"] + m["ab"]).reshape(*h.shape[:2], -1)
    e = u @ m["av"]
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * h).sum(0)
    if saved is not None:
        saved |= {"steps": steps, "h": h, "u": u, "a": a, "pooled": pooled}
    return pooled @ m["ow"] + m["ob"][0]


def _gradients(m: dict[str, np.ndarray], ids: np.ndarray, tokens: list[bytes], rows: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    cs: dict = {}
    ws: dict = {}
    x = _vectors(m, ids, tokens, cs)
    both = _projected(m, x)
    n = m["wuf"].shape[0]
    p = _sigmoid(_windows(m, both[:, : 3 * n], both[:, 3 * n :], rows, ws))
    loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
    g = {}
    h, u, a, pooled = ws["h"], ws["u"], ws["a"], ws["pooled"]
    d = ((p - y) / len(y)).astype(np.float32)
    g["ow"], g["ob"] = pooled.T @ d, d.sum(keepdims=True)
    dp = d[:, None] * m["ow"]
    dh = a[:, :, None] * dp
    da = (h * dp).sum(2)
    de = a * (da - (a * da).sum(0))
    flat = lambda v: v.reshape(-1, v.shape[-1])
    g["av"] = flat(u).T @ de.ravel()
    du = de[:, :, None] * m["av"] * _slope(u)
    g["aw"], g["ab"] = flat(h).T @ flat(du), du.sum((0, 1))
    dh += du @ m["aw"].T
    dx = np.zeros_like(x)
    for side in "fb":
        part = dh[:, :, :n] if side == "f" else dh[::-1, :, n:]
        dxp, g[f"wu{side}"] = _gru_back(part, ws["steps"][side], m[f"wu{side}"])
        each = _summed((rows if side == "f" else rows[::-1]).ravel(), np.concatenate(dxp), len(x))
        g[f"ww{side}"], g[f"wb{side}"] = x.T @ each, each.sum(0)
        dx += each @ m[f"ww{side}"].T
    wd, cn = m["words"].shape[1], m["cuf"].shape[0]
    g["words"] = _summed(ids, dx[:, :wd], len(m["words"]))
    g["words"][0] = 0
    g["chars"] = np.zeros_like(m["chars"])
    for i, side in enumerate("fb"):
        at, steps = cs[side]
        ds = np.zeros((len(at), len(x), cn), np.float32)
        ds[-1] = dx[cs["order"], wd + i * cn : wd + (i + 1) * cn]
        dxp, g[f"cu{side}"] = _gru_back(ds, steps, m[f"cu{side}"])
        each = _summed(np.concatenate([at[t, :k] for t, k in enumerate(cs["active"])]), np.concatenate(dxp), 256)
        g[f"cw{side}"], g[f"cb{side}"] = m["chars"].T @ each, each.sum(0)
        g["chars"] += each @ m[f"cw{side}"].T
    return loss, g


# ---------------------------------------------------------------- scoring


def window_starts(n: int, window: int, stride: int) -> np.ndarray:
    """Starts of overlapping windows that cover n tokens; the last ends at the end."""
    if n <= window:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - window, stride), n - window)


class Scorer:
    """Scores texts with a model; keeps what the word network takes of the words seen so far (bounded)."""

    KEEP = 100_000

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((0, 6 * model.config.hidden), np.float32)
        self.used = 0

    def _rows(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.index) > self.KEEP:
            self.index, self.used = {}, 0
        index, m = self.index, self.model.weights
        fresh = [t for t in dict.fromkeys(tokens) if t not in index]
        if self.used + len(fresh) > len(self.table):
            grown = np.zeros((2 * (self.used + len(fresh)), self.table.shape[1]), np.float32)
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        for i in range(0, len(fresh), 4096):
            some = fresh[i : i + 4096]
            ids = np.fromiter((self.model.vocabulary.get(t, 0) for t in some), np.int64, len(some))
            self.table[self.used : self.used + len(some)] = _projected(m, _vectors(m, ids, some, None))
            index.update(zip(some, range(self.used, self.used + len(some)), strict=True))
            self.used += len(some)
        return np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))

    def windows(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all windows of all docs (none of them empty): doc number, start, score.  A text shorter than a window is read again from its start."""
        c = self.model.config
        rows = self._rows([t for d in docs for t in d])
        n = np.array([len(d) for d in docs], np.int64)
        bases = np.concatenate([[0], np.cumsum(n)[:-1]])
        starts = [window_starts(len(d), c.window, c.stride) for d in docs]
        owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        start, scores = np.concatenate(starts), np.empty(len(owner), np.float32)
        forth, back = np.ascontiguousarray(self.table[: self.used, : 3 * c.hidden]), np.ascontiguousarray(self.table[: self.used, 3 * c.hidden :])
        step = np.arange(c.window)[:, None]
        for i in range(0, len(owner), 1024):
            o, s = owner[i : i + 1024], start[i : i + 1024]
            at = rows[bases[o] + (s + step) % n[o]]
            scores[i : i + 1024] = _sigmoid(_windows(self.model.weights, forth, back, at, None))
        return owner, start, scores

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The largest window score of each text."""
        out = np.full(len(texts), self.model.empty_score, np.float64)
        if self.model.constant:
            return out
        some: list[int] = []
        size, tokens = 0, []
        for i, text in enumerate([*texts, None]):
            t = pieces_of(text) if i < len(texts) else []
            if t:
                some.append(i)
                tokens.append(t)
                size += len(t)
            if tokens and (size > 60_000 or i == len(texts)):
                owner, _, s = self.windows(tokens)
                best = np.full(len(tokens), -1.0)
                np.maximum.at(best, owner, s.astype(np.float64))
                out[some] = best
                some, tokens, size = [], [], 0
        return np.round(out, 6)


# ---------------------------------------------------------------- training


Windows = tuple[np.ndarray, np.ndarray, np.ndarray]  #: document, start, score


def _mined(model: Model, docs: list[list[bytes]]) -> Windows:
    """All windows of all docs, a few docs at a time to bound what the scorer holds."""
    scorer, parts = Scorer(model), []
    for i in range(0, len(docs), 100):
        owner, at, score = scorer.windows(docs[i : i + 100])
        parts.append((owner + i, at, score))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _ranked(owner: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by document and falling score, and each row's rank there."""
    order = np.lexsort((-score, owner))
    return order, np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])


def telling_words(docs: list[list[bytes]], labels: np.ndarray, least: float = 12.0) -> dict[bytes, float]:
    """Words that tell a toxic document, with their log-odds: by themselves or by a stretch of 4 to 6 bytes of their spelling (ends marked).

    What tells has to be so much likelier among toxic documents that chance would bring it once in e^``least``; stretches are counted in hashed cells.
    """
    size, cells = 1 << 20, {}

    def cells_of(word: bytes) -> np.ndarray:
        marked = b"^" + word + b"$"
        parts = {marked, *(marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1))}
        return np.fromiter((zlib.crc32(x) % size for x in parts), np.int32, len(parts))

    found = np.zeros((2, size))
    for d, label in zip(docs, labels, strict=True):
        own = set(d)
        for w in own:
            if w not in cells:
                cells[w] = cells_of(w)
        found[label, np.unique(np.concatenate([cells[w] for w in own]))] += 1
    n = np.bincount(labels, minlength=2)
    share, both = n[1] / n.sum(), found.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(found[1] * np.log(found[1] / (both * share))) + np.nan_to_num(found[0] * np.log(found[0] / (both * (1 - share))))
    ratio = np.log((found[1] + 0.5) / (n[1] + 1)) - np.log((found[0] + 0.5) / (n[0] + 1))
    tells = np.where((gain >= least) & (found[1] > both * share), ratio, 0.0)
    return {w: t for w, c in cells.items() if (t := float(tells[c].max())) > 0}


def train(texts: list[str | None], toxic: list[int], config: TrainConfig = TrainConfig(), mine: Callable[[Model], Windows] | None = None) -> Model:
    """Fit on labelled texts (the caller bounds how many).  One class only: a constant model.

    ``mine`` scores the texts' windows with the model of the moment (documents by their place in ``texts``); without it they are scored here."""
    docs, y, place = [], [], {}
    pool: dict[bytes, bytes] = {}  # equal words are one object
    for i, (t, label) in enumerate(zip(texts, toxic, strict=True)):
        if p := pieces_of(t):
            place[i] = len(docs)
            docs.append([pool.setdefault(w, w) for w in p])
            y.append(int(label))
    share = float(np.mean(toxic)) if toxic else 0.0
    empty = min(round(share, 6), 0.49)
    if len(set(y)) < 2:
        return Model(config, {}, {}, round(share, 6), constant=True)
    found = Counter(w for d in docs for w in set(d))
    common = sorted((w for w, n in found.items() if n >= config.min_count), key=lambda w: (-found[w], w))
    vocabulary = {w: i + 1 for i, w in enumerate(common[: config.vocabulary])}
    model = Model(config, vocabulary, initial_weights(config, len(vocabulary)), empty)
    labels, rng = np.array(y), np.random.default_rng(config.seed)
    starts = [window_starts(len(d), config.window, config.stride) for d in docs]
    odds = telling_words(docs, labels)
    for w, i in vocabulary.items():  # training begins with what the words alone tell
        model.weights["words"][i, 0] = min(odds.get(w, 0.0), 3.0) / 2
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    step, steps, mean = 0, 0, {k: np.zeros_like(v) for k, v in model.weights.items()}
    for epoch in range(config.epochs):
        if epoch < 2:  # the windows with the words most peculiar to toxic documents
            chosen: list[tuple[int, int]] = []
            for d, s in enumerate(starts):
                tell = np.array([odds.get(w, 0.0) for w in docs[d]])
                peak = np.array([tell[i : i + config.window].max() for i in s])
                top = np.argsort(-peak, kind="stable")
                # a toxic document's windows without such a word are most likely clean ones
                chosen += [(d, int(s[i])) for k, i in enumerate(top[: 2 if labels[d] else 1]) if not labels[d] or peak[i] > 0]
                if not labels[d]:
                    chosen.append((d, int(rng.choice(s))))
        elif epoch % 2 == 0:
            chosen = []
            if mine:
                owner, at, score = mine(model)
                owner = np.array([place[i] for i in owner.tolist()], np.int64)
            else:
                owner, at, score = _mined(model, docs)
            order, rank = _ranked(owner, score)
            for o, r in zip(order, rank, strict=True):
                d = owner[o]
                if (r == 0 and (not labels[d] or score[o] > config.doubt)) or (labels[d] and r < 3 and score[o] > 0.8) or (not labels[d] and (score[o] > 0.02 or r == 1)):
                    chosen.append((int(d), int(at[o])))
            chosen += [(d, int(rng.choice(s))) for d, s in enumerate(starts) if not labels[d]]
        rng.shuffle(chosen)
        rate = config.rate * (1 - epoch / config.epochs) + 0.001
        batch = min(config.batch, max(16, len(chosen) // config.steps))  # small samples get steps enough
        for b in range(0, len(chosen), batch):
            some = chosen[b : b + batch]
            parts = [[docs[d][(s + i) % len(docs[d])] for i in range(config.window)] for d, s in some]
            index = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
            tokens = list(index)
            rows = np.array([[index[w] for w in p] for p in parts], np.int64).T
            ids = np.array([vocabulary.get(w, 0) for w in tokens], np.int64)
            ids[rng.random(len(ids)) < config.spelled] = 0  # by spelling alone
            target = labels[[d for d, _ in some]].astype(np.float32)
            _, g = _gradients(model.weights, ids, tokens, rows, target)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k, v in g.items():
                v = v * np.float32(min(1.0, 2.0 / (norm + 1e-9)))
                m1, m2 = moment[k]
                m1 += np.float32(0.1) * (v - m1)
                m2 += np.float32(0.01) * (v * v - m2)
                model.weights[k] -= np.float32(rate) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + np.float32(1e-6))
            if epoch >= config.epochs - config.averaged:
                steps += 1
                for k, v in model.weights.items():
                    mean[k] += (v - mean[k]) / np.float32(steps)
    model.weights = mean
    return model


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(doc_id, toxic, text) of at most so many labelled rows of each class, none of them held out.

    Held out is crc32(doc_id as text) mod 5 = 0.  The order that picks is a hash of the id, so it does
    not depend on partitioning.  Null labels are left out; of contradicting labels the larger holds, of several texts of one id the smallest.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    key = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    some = known.filter("toxic = 1").orderBy(*key).limit(max_toxic).unionByName(known.filter("toxic = 0").orderBy(*key).limit(max_clean))
    # bounded by max_toxic + max_clean rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, config: TrainConfig = TrainConfig()) -> Model:
    """Train on the bounded sample of labelled rows; the sample (not the corpus) comes to the driver, which takes the gradient steps.
    Its windows are scored in Spark's tasks."""
    spark = docs.sparkSession
    sample = materialize(training_rows(docs, labels, config.max_per_class, config.max_clean).repartition(2 * spark.sparkContext.defaultParallelism, "doc_id"), "sample")
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    texts, toxic, ids = rows["text"].tolist(), rows["toxic"].tolist(), {d: i for i, d in enumerate(rows["doc_id"].tolist())}
    del rows
    kind = sample.schema["doc_id"].dataType.simpleString()

    def mine(model: Model) -> Windows:
        sent = spark.sparkContext.broadcast((model.config, model.vocabulary, model.weights))

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Model(*sent.value)
            for pdf in batches:
                tokens = [pieces_of(t) for t in pdf["text"]]
                some = [i for i, t in enumerate(tokens) if t]
                if some:
                    owner, at, score = _mined(own, [tokens[i] for i in some])
                    order, rank = _ranked(owner, score)
                    order = order[(rank < 3) | (score[order] > 0.02)]  # no others are looked at
                    yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[np.array(some)[owner[order]]], "at": at[order], "score": score[order].astype(float)})

        found = sample.mapInPandas(scored, f"doc_id {kind}, at long, score double").toPandas()
        sent.unpersist()
        owner = np.array([ids[d] for d in found["doc_id"].tolist()], np.int64)
        order = np.lexsort((found["at"], owner))  # however the tasks' rows come
        return owner[order], found["at"].to_numpy()[order], found["score"].to_numpy()[order]

    return train(texts, toxic, config, mine)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score of every text in ``out`` (which replaces a column of that name).  No shuffle."""
    docs = without(docs, out) if out != text else docs
    sent = docs.sparkSession.sparkContext.broadcast((model.config, model.vocabulary, model.weights, model.empty_score, model.constant))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(*sent.value))
        for p in parts:
            yield pd.Series(scorer.scores(p.tolist()))

    return docs.withColumn(out, scored(F.col(text)))
