"""Toxicity by a bidirectional gated recurrent network with attention pooling.

The network reads windows of words. A word enters as numbers from two sources:
the whole word, and its character n-grams (4 to 6, with word ends), pooled; each
as smoothed log-odds of labelled documents, estimated on the fold the network
doesn't learn from. Gated recurrent units run over a window both ways, attention
pools their states, and a sigmoid gives the window's score. Every window of
every text is scored (32 words, the last 8 shared with the next window), and a text's score comes from
its highest window, on a scale fitted to labelled texts. Trained in numpy on the
driver on a bounded number of labelled rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import held, let_go, small_batches

WORD = re.compile(r"[^\W\d_]+|\d+")
#: Words of a window and words from one window's start to the next.
WINDOW, STRIDE = 32, 24
UNITS = 8
GRAMS = (4, 5, 6)
INPUTS = 2 + 2 * len(GRAMS)
#: Labelled rows learnt from at most, for each of the two classes.
MOST_ROWS = 1000
REJECT = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id's text mod 3 is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(word: str) -> list[list[str]]:
    w = f"^{word}$"
    return [[w[i : i + n] for i in range(len(w) - n + 1)] for n in GRAMS]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Odds:
    """Log-odds of words and character n-grams of a set of labelled texts."""

    words: dict[str, float] = field(default_factory=dict)
    grams: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, texts: list[list[str]], labels: np.ndarray) -> Odds:
        out, n1, n0 = cls(), labels.sum() + 2.0, (1 - labels).sum() + 2.0
        sets = [set(words) for words in texts]
        cut = lambda w, n: (w[i : i + n] for i in range(len(w) - n + 1))
        out._count(sets, labels, lambda own: own, out.words, 3, n1, n0)
        for n in GRAMS:  # one length at a time, so that few are held at once
            out._count(sets, labels, lambda own, n=n: {g for w in own for g in cut(f"^{w}$", n)}, out.grams, 6, n1, n0)
        return out

    @staticmethod
    def _count(sets: list[set], labels: np.ndarray, pick: Callable, kept: dict, least: int, n1: float, n0: float) -> None:
        """Keep the log-odds of what ``least`` texts or more hold. A count is that of toxic texts times 2^32, plus the others'."""
        seen: dict[str, int] = {}
        for own, y in zip(sets, labels, strict=True):
            step = 1 << 32 if y else 1
            for k in pick(own):
                seen[k] = seen.get(k, 0) + step
        for k, both in seen.items():
            b, a = both >> 32, both & 0xFFFFFFFF
            if a + b >= least:
                odds = np.log((b + 0.5) / n1) - np.log((a + 0.5) / n0)
                if abs(odds) > 0.4:
                    kept[k] = float(np.clip(odds, -4, 4) / 2)

    def inputs(self, word: str) -> list[float]:
        out = [self.words.get(word, 0.0), float(word in self.words)]
        for gs in grams_of(word):
            x = [self.grams.get(g, 0.0) for g in gs] or [0.0]
            out += [max(x), sum(x) / len(x)]
        return out


def windows(n: int) -> list[int]:
    """Starts of the windows of a text of n words: all overlapping windows, the last reaching its end."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


SHAPES = {"wx": (2, INPUTS, 3 * UNITS), "b": (2, 3 * UNITS), "wh": (2, UNITS, 3 * UNITS), "wa": (2 * UNITS, UNITS), "va": (UNITS,), "wo": (2 * UNITS,), "bo": (1,)}


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {k: (rng.standard_normal(s) * 0.4 / np.sqrt(s[-2] if len(s) > 1 else 4)).astype("f4") if k != "bo" else np.full(1, -1.0, "f4") for k, s in SHAPES.items()}


def forward(p: dict, gates: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
    """Window scores (before the sigmoid). gates: [2, T, B, 3U] input parts; mask: [T, B]."""
    _, T, B, _ = gates.shape
    states, kept = np.empty((T, B, 2 * UNITS), "f4"), [[None] * T, [None] * T]
    for way in (0, 1):
        h, wh = np.zeros((B, UNITS), "f4"), p["wh"][way]
        for t in range(T) if way == 0 else range(T - 1, -1, -1):
            x, m = gates[way, t], mask[t][:, None]
            rec = h @ wh
            zr = 1 / (1 + np.exp(-(x[:, : 2 * UNITS] + rec[:, : 2 * UNITS])))
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            c = np.tanh(x[:, 2 * UNITS :] + r * rec[:, 2 * UNITS :])
            new = h + m * z * (c - h)
            if keep:
                kept[way][t] = (h, z, r, c, rec)
            h = new
            states[t, :, way * UNITS : (way + 1) * UNITS] = h
    u = np.tanh(states @ p["wa"])
    a = u @ p["va"] + (mask - 1) * 30
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tb,tbs->bs", a, states)
    return pooled @ p["wo"] + p["bo"][0], (states, kept, u, a, pooled)


def backward(p: dict, x: np.ndarray, mask: np.ndarray, stuff: tuple, d: np.ndarray) -> dict:
    """Gradients of the parameters for d = dloss/dscore. x: [T, B, INPUTS]."""
    states, kept, u, a, pooled = stuff
    T, B, _ = states.shape
    g = {k: np.zeros(s, "f4") for k, s in SHAPES.items()}
    g["wo"], g["bo"] = pooled.T @ d, np.array([d.sum()], "f4")
    dpool = d[:, None] * p["wo"]
    ds = a[:, :, None] * dpool
    da = np.einsum("tbs,bs->tb", states, dpool)
    da = a * (da - (a * da).sum(0))
    g["va"] = np.einsum("tb,tbu->u", da, u)
    du = da[:, :, None] * p["va"] * (1 - u * u)
    g["wa"] = np.einsum("tbs,tbu->su", states, du)
    ds = ds + du @ p["wa"].T
    for way in (0, 1):
        wh, dh = p["wh"][way], np.zeros((B, UNITS), "f4")
        for t in range(T - 1, -1, -1) if way == 0 else range(T):
            h, z, r, c, rec = kept[way][t]
            m = mask[t][:, None]
            dh = dh + ds[t, :, way * UNITS : (way + 1) * UNITS]
            dz = dh * m * (c - h) * z * (1 - z)
            dc = dh * m * z * (1 - c * c)
            dr = dc * rec[:, 2 * UNITS :] * r * (1 - r)
            gates = np.concatenate([dz, dr, dc], 1)
            back = np.concatenate([dz, dr, dc * r], 1)
            g["wx"][way] += x[t].T @ gates
            g["b"][way] += gates.sum(0)
            g["wh"][way] += h.T @ back
            dh = dh * (1 - m * z) + back @ wh.T
    return g


@dataclass
class Model:
    """Network, inputs and the scale from a text's highest window to its score."""

    p: dict[str, np.ndarray]
    odds: Odds
    slope: float = 1.0
    shift: float = 0.0

    def tops(self, texts: list[str | None], memory: Memory) -> np.ndarray:
        """The highest window of each text."""
        found = [words_of(t) for t in texts]
        memory.learn({w for words in found for w in words}, self.odds)
        ids, owner = [], []
        for words in found:
            row = np.fromiter(map(memory.place.__getitem__, words), np.int32, len(words))
            if len(words) <= WINDOW:
                row = np.pad(row, (0, WINDOW - len(words)))
            starts = windows(len(words))
            ids.append(np.lib.stride_tricks.sliding_window_view(row, WINDOW)[starts])
            owner.append(len(starts))
        seen = np.concatenate(ids)
        own, seen = np.unique(seen, return_inverse=True)  # the padding, 0, may or may not be among them
        seen, pad = seen.reshape(-1, WINDOW), len(own) > 0 and own[0] == 0
        x = memory.table[own]
        table = np.stack([(x @ self.p["wx"][way] + self.p["b"][way]).T for way in (0, 1)])
        score = np.empty(len(seen), "f4")
        for a in range(0, len(seen), 1024):
            part = seen[a : a + 1024].T
            score[a : a + 1024] = infer(self.p, table, np.ascontiguousarray(part), (part > 0) if pad else None)
        return np.maximum.reduceat(score, np.concatenate([[0], np.cumsum(owner)[:-1]]))

    def scores(self, texts: list[str | None], memory: Memory) -> np.ndarray:
        return sigmoid(self.slope * self.tops(texts, memory).astype("f8") + self.shift)


class Memory:
    """Inputs of the words met so far, row 0 for the padding; emptied when full."""

    def __init__(self, most: int = 300_000) -> None:
        self.most, self.place, self.table = most, {}, np.zeros((1024, INPUTS), "f4")

    def learn(self, words: set[str], odds: Odds) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > self.most:
            self.place.clear()
            new = list(words)
        n = len(self.place) + 1
        while n + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if new:
            self.table[n : n + len(new)] = [odds.inputs(w) for w in new]
            self.place.update(zip(new, range(n, n + len(new)), strict=True))


def infer(p: dict, table: np.ndarray, ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Window scores as ``forward`` gives them, with units before windows in memory and nothing kept."""
    T, B = ids.shape
    states = np.empty((2 * UNITS, T, B), "f4")
    for way in (0, 1):
        wh, h = np.ascontiguousarray(p["wh"][way].T), np.zeros((UNITS, B), "f4")
        for t in range(T) if way == 0 else range(T - 1, -1, -1):
            x, rec = table[way][:, ids[t]], wh @ h
            zr = x[: 2 * UNITS]
            zr += rec[: 2 * UNITS]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c, back = x[2 * UNITS :], rec[2 * UNITS :]
            back *= zr[UNITS:]
            c += back
            np.tanh(c, out=c)
            c -= h
            c *= zr[:UNITS]
            if mask is not None:
                c *= mask[t]
            h += c
            states[way * UNITS : (way + 1) * UNITS, t] = h
    flat = states.reshape(2 * UNITS, T * B)
    a = (p["va"] @ np.tanh(np.ascontiguousarray(p["wa"].T) @ flat)).reshape(T, B)
    if mask is not None:
        a += (mask - 1.0).astype("f4") * 30
    a = np.exp(a - a.max(0))
    worth = (p["wo"] @ flat).reshape(T, B)
    return (a * worth).sum(0) / a.sum(0) + p["bo"][0]


def train(texts: list[str | None], labels: list[int], seed: int = 3, rounds: int = 4) -> Model:
    """Fit on labelled texts; without both labels the model gives every text the labels' mean."""
    y = np.array(labels, "f4")
    rng = np.random.default_rng(seed)
    same: dict[str, str] = {}
    words = [[same.setdefault(w, w) for w in words_of(t)] for t in texts]  # each word once in memory
    p = fresh(rng)
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.0
        return Model(p, Odds(), 0.0, float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
    fold = rng.permutation(len(y)) % 2
    odds = [Odds.of([w for w, f in zip(words, fold, strict=True) if f != k], y[fold != k]) for k in (0, 1)]
    data, owner = [], []
    for i, w in enumerate(words):
        cache = odds[fold[i]]
        x = np.array([cache.inputs(v) for v in w], "f4").reshape(-1, INPUTS)
        starts = windows(len(w))
        own = np.zeros((len(starts), WINDOW, INPUTS), "f4")
        for k, s in enumerate(starts):
            part = x[s : s + WINDOW]
            own[k, : len(part)] = part
        mask = np.zeros((len(starts), WINDOW), "f4")
        for k, s in enumerate(starts):
            mask[k, : max(0, min(WINDOW, len(w) - s))] = 1
        data.append((own, mask))
        owner.append(len(starts))
    X, M = np.concatenate([d[0] for d in data]), np.concatenate([d[1] for d in data])
    del data
    doc = np.repeat(np.arange(len(y)), owner)
    edge = np.concatenate([[0], np.cumsum(owner)[:-1]])
    # a first guess of each window: its strongest word
    top = (X[:, :, 0] + X[:, :, 2:].max(2)).max(1)
    m, v, t = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0

    def scored() -> np.ndarray:
        out = np.empty(len(X), "f4")
        for a in range(0, len(X), 1024):
            out[a : a + 1024] = forward(p, gates_of(p, X[a : a + 1024].transpose(1, 0, 2)), M[a : a + 1024].T)[0]
        return out

    for epoch in range(rounds):
        best = np.maximum.reduceat(top, edge)
        pick = top >= best[doc] - 1e-6  # of toxic texts the highest window alone is known to be toxic
        plus = np.flatnonzero(pick & (y[doc] == 1))
        minus = np.flatnonzero(y[doc] == 0)
        hard = minus[np.argsort(-top[minus])[: 2 * len(plus)]]
        minus = np.concatenate([hard, rng.choice(minus, min(len(minus), 4 * len(plus)), replace=False)])
        order = rng.permutation(np.concatenate([np.repeat(plus, 2), minus]))
        for a in range(0, len(order), 256):
            b = order[a : a + 256]
            x, mask = np.ascontiguousarray(X[b].transpose(1, 0, 2)), np.ascontiguousarray(M[b].T)
            s, stuff = forward(p, gates_of(p, x), mask, True)
            g = backward(p, x, mask, stuff, ((sigmoid(s) - y[doc[b]]) / len(b)).astype("f4"))
            t += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.002 * (g[k] ** 2 - v[k])
                p[k] = (p[k] - 8e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.998**t)) + 1e-7)).astype("f4")
        top = scored()
    best = np.maximum.reduceat(top, edge).astype("f8")
    slope, shift = platt(best, y)
    return Model(p, Odds.of(words, y), slope, shift)


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on the highest windows, a little damped."""
    a, b = 1.0, 0.0
    for _ in range(60):
        q = sigmoid(a * x + b)
        w = q * (1 - q) + 1e-6
        g = np.array([((q - y) * x).sum() + 0.01 * a, (q - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 1e-3)), float(b)


def gates_of(p: dict, x: np.ndarray) -> np.ndarray:
    return np.stack([x @ p["wx"][way] + p["b"][way] for way in (0, 1)])


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """A model of the labelled rows that aren't held out, ``most_rows`` of each class at most (smallest MD5 of the id).

    A doc_id with several labels counts as toxic if one of them says so; one
    with several texts is learnt by the smallest. Other labels than 0 and 1 and
    null ids are left out.
    """
    told = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    learnt = told.where(~held_out(F.col("doc_id"))).withColumn("k", F.md5(F.col("doc_id").cast("string")))
    some = learnt.where("toxic = 1").orderBy("k").limit(most_rows).union(learnt.where("toxic = 0").orderBy("k").limit(most_rows))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # 2 x most_rows ids at most
    rows = own.groupBy("doc_id", "k", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).orderBy("k", "doc_id").select("text", "toxic").collect()
    model = train([r.text for r in rows], [r.toxic for r in rows])
    del rows
    let_go()  # what fitting took goes back to the system
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and ``score``.

    A null or empty text is one empty window. Rows are scored each; an empty
    table gives no rows. Only the text is read by the model.
    """
    small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # words and n-grams of the bounded sample

    def run(texts: pd.Series) -> pd.Series:
        m = shared.value
        memory = held(("toxicity inputs", name), Memory)
        out = [m.scores(list(texts.iloc[a : a + 256]), memory) for a in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(out) if out else [], dtype="f8")

    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return own.select("row", F.pandas_udf(run, "double")("row.text").alias("score"))
