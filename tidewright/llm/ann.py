"""Nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced parts (recursive
spectral bisection at the median, then swaps of the best gains), and a small
network learns to tell from a vector which parts its neighbours are in. Every
row of the table is indexed under its most probable part; a query is compared
with the rows of several most probable parts, and those are ranked by the exact
measure. How many parts a query visits is set on held-out rows of the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import cut, grouped
from tidewright.llm.embdedup import as_bytes, kind_of, usable

#: Rows of a part or queries that meet in one task at most.
CHUNK, QUERY_BLOCK = 4096, 1024
#: Parts of vectors whose length is not the model's: searched whole.
ODD = 1 << 20
#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Router:
    """Part probabilities of a vector: one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """k nearest rows of each row by inner product, itself left out; in blocks."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(nodes: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``nodes`` with few graph edges between them."""
    place = np.full(len(near), -1)
    place[nodes] = np.arange(len(nodes))
    i = np.repeat(np.arange(len(nodes)), near.shape[1])
    j = place[near[nodes]].ravel()
    i, j = i[j >= 0], j[j >= 0]
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    n = len(nodes)
    degree = np.maximum(1, np.bincount(i, minlength=n))
    v = rng.standard_normal(n)
    for _ in range(60):  # power iteration towards the second eigenvector of the walk
        v = v + np.bincount(i, v[j], n) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) or 1
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        gain = np.bincount(i, np.where(side[i] != side[j], 1.0, -1.0), n)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b), max(1, n // 20))
        m = int((gain[a[:m]] + gain[b[:m]] > 2).sum())
        if not m:
            break
        side[a[:m]], side[b[:m]] = False, True
    return nodes[~side], nodes[side]


def fit(x: np.ndarray, parts: int, *, k: int, target: float, seed: int = 11, hidden: int = 128, rounds: int = 60) -> Router:
    """Learn a router of ``parts`` parts (a power of two) from sample rows ``x`` (double)."""
    rng = np.random.default_rng(seed)
    n = len(x)
    near = graph(x, min(max(1, n - 1), 10))
    cells = [np.arange(n)]
    while len(cells) < parts:
        cells = [half for c in cells for half in bisect(c, near, rng)]
    label = np.empty(n, np.int64)
    for p, c in enumerate(cells):
        label[c] = p
    aim = np.zeros((n, parts))
    for col in range(near.shape[1]):
        np.add.at(aim, (np.arange(n), label[near[:, col]]), 1.0)
    aim[np.arange(n), label] += 1
    aim /= aim.sum(1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = rng.permutation(n)[: max(1, min(600, n // 6))]
    learn = np.setdiff1d(np.arange(n), asked)
    if not len(learn):
        learn = asked
    w = [rng.standard_normal((x.shape[1], hidden)) / 4, np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(rounds):
        order = rng.permutation(learn)
        for a in range(0, len(order), 256):
            b = order[a : a + 256]
            h = np.tanh(unit[b] @ w[0] + w[1])
            z = h @ w[2] + w[3]
            e = np.exp(z - z.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - aim[b]) / len(b)
            dh = d @ w[2].T * (1 - h * h)
            t += 1
            for q, g in enumerate((unit[b].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[q] += 0.1 * (g - m[q])
                v[q] += 0.001 * (g * g - v[q])
                w[q] -= 3e-3 * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
    router = Router(*w, probes=parts)
    z = router.logits(x)
    home, way = z.argmax(1), np.argsort(-z[asked], axis=1)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-s, axis=1)[:, : min(k, n - 1)]
    rank = np.empty_like(way)
    np.put_along_axis(rank, way, np.arange(parts)[None, :].repeat(len(asked), 0), 1)
    seen = np.take_along_axis(rank, home[best], 1) if best.size else np.zeros((1, 1), np.int64)
    probes = next(p for p in range(1, parts + 1) if (seen < p).mean() >= target)
    return Router(*w, probes=probes)


def search(vectors: DataFrame, asks: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = 20, sample_rows: int = 8192, target: float = 0.97) -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank, vec_id, score.

    ``asks`` holds ids of rows of ``vectors`` that are queries; the candidates
    are all rows but the query's own row. Ties go to the smaller id (null ids
    last). Null, zero and non-finite vectors take no part; vectors of another
    length than the sample's most common are compared with their like, all of
    them. Repeated rows are candidates each. An empty table gives no rows. The
    router is fitted on at most ``sample_rows`` rows (those of the smallest
    hashed ids), every row is indexed. The number of parts grows with the root of
    the rows up to a part for 32 sample rows; parts over 4,096 rows are split in
    chunks that a query visits one and all. A query id that is repeated in
    ``asks`` is one query; repeated rows of one id are queries each.
    """
    spark, kind = vectors.sparkSession, kind_of(vectors, vector)
    good = vectors.where(usable(F.col(vector))).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    rows = cut(as_bytes(good, "v", "id long")).withColumn("u", F.monotonically_increasing_id())
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = [np.frombuffer(r[0], kind).astype("f8") for r in rows.orderBy(F.xxhash64("id"), "u").limit(sample_rows).select("v").collect()]
    lengths = pd.Series([len(x) for x in sample])
    d = int(lengths.mode()[0])
    sample = np.array([x for x in sample if len(x) == d])
    parts = 1  # a power of two near half the root of the rows, with 32 sample rows each or more
    while 16 * parts * parts <= n and 64 * parts <= len(sample):
        parts *= 2
    shared = spark.sparkContext.broadcast(fit(sample, parts, k=k, target=target))  # bounded by d, hidden units and sample_rows / 32 parts
    wanted = asks.select(F.col(asks.columns[0]).cast("long").alias("id")).distinct()

    def route(batches):
        router = shared.value
        for b in batches:
            if not len(b):
                continue
            ways: list = [None] * len(b)
            size = b["v"].str.len().to_numpy() // np.dtype(kind).itemsize
            for length in np.unique(size):
                at = np.flatnonzero(size == length)
                if length != d:
                    for i in at:
                        ways[i] = [int(ODD + length)]
                    continue
                z = router.logits(np.stack([np.frombuffer(b["v"].iloc[i], kind) for i in at]).astype("f8"))
                order = np.argsort(-z, axis=1, kind="stable")[:, : router.probes]
                for i, w in zip(at, order.tolist(), strict=True):
                    ways[i] = w
            out = b[["id", "u", "v"]].copy()
            out["ways"] = ways
            yield out

    index = cut(rows.mapInPandas(route, "id long, u long, v binary, ways array<int>"))
    home = index.withColumn("part", F.col("ways")[0])
    asked = index.join(wanted, "id", "left_semi").select("id", "u", "v", F.explode("ways").alias("part"))
    # a row a part: at most sample_rows / 32, and one for each odd vector length
    many = home.groupBy("part").count().withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).select("part", "chunks")
    queried = asked.groupBy("part").count().withColumn("blocks", F.ceil(F.col("count") / QUERY_BLOCK).cast("int")).select("part", "blocks")
    dealt = many.join(queried, "part")
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    cands = home.join(dealt, "part").select("id", "u", "v", F.lit(False).alias("ask"), "part", spread("u", "chunks").alias("chunk"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("qb"))
    quests = asked.join(dealt, "part").select("id", "u", "v", F.lit(True).alias("ask"), "part", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), spread("u", "blocks").alias("qb"))

    def rank(g: pd.DataFrame) -> pd.DataFrame | None:
        ask = g["ask"].to_numpy()
        if ask.all() or not ask.any():
            return None
        x = np.stack([np.frombuffer(v, kind) for v in g["v"]]).astype("f8")
        q, c = x[ask], x[~ask]
        qu, cu = g["u"].to_numpy()[ask], g["u"].to_numpy()[~ask]
        order_id = g["id"].astype("Int64")[~ask].fillna(NO_ID).to_numpy("i8")
        qid, outs = g["id"].astype("Int64")[ask].array, []
        for a in range(0, len(q), 256):
            s = q[a : a + 256] @ c.T
            s[qu[a : a + 256, None] == cu[None, :]] = -np.inf
            edge = np.partition(s, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(s), -np.inf)
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
            i, j = np.nonzero((s >= (edge - slack)[:, None]) & (s > -np.inf))
            exact = np.empty(len(i))
            for b in range(0, len(i), 65536):  # the same order of additions for every pair, so equal vectors score equal
                exact[b : b + 65536] = (q[a + i[b : b + 65536]] * c[j[b : b + 65536]]).sum(1)
            o = np.lexsort((order_id[j], -exact, i))
            first = np.searchsorted(i[o], i[o], "left")
            o = o[np.arange(len(o)) - first < k]
            edges = np.flatnonzero(np.diff(i[o], prepend=-1))
            who = i[o][edges]
            split = lambda x: np.split(x, edges[1:])
            outs.append(pd.DataFrame({"qu": qu[a + who], "query_id": qid[a + who], "ids": split(order_id[j[o]]), "scores": split(exact[o])}))
        return pd.concat(outs)

    # a row a query and block; a query's rows are merged as arrays of at most k each
    near = grouped(cands.union(quests), ["part", "chunk", "qb"], rank, "qu long, query_id long, ids array<long>, scores array<double>")
    pairs = F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("far"), i.alias("vec_id")))
    merged = near.select("qu", "query_id", pairs.alias("p")).groupBy("qu").agg(F.any_value("query_id").alias("query_id"), F.flatten(F.collect_list("p")).alias("p"))
    best = merged.select("query_id", F.posexplode(F.slice(F.array_sort("p"), 1, k)).alias("at", "p"))
    vec_id = F.when(F.col("p.vec_id") != NO_ID, F.col("p.vec_id"))
    return best.select("query_id", (F.col("at") + 1).alias("rank"), vec_id.alias("vec_id"), (-F.col("p.far")).alias("score"))
