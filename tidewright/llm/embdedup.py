"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Vectors are dealt in blocks of their order along one direction (the sample's
main one). Along a unit direction two vectors with cosine >= t differ by at most
sqrt(2 - 2t), so a block meets only blocks within that distance: nothing is
lost there. Where two blocks meet, one is sorted along each of ``projections``
random directions, and each vector of the other has a window centred on it in
every one of these orders. A pair collides where one vector's rank lies in the
other's window; collisions are counted for each pair. The count a pair must
reach is the highest that a pair of cosine exactly t misses with probability
``miss`` (collisions over independent directions are binomial). Pairs that
reach it are verified in double precision. Equal vectors are one class
throughout; within a block pair only link counts and a spanning forest leave
the task, never all pairs.

Work grows with the square of the distinct vectors unless the main direction
separates them: a window on any one direction that keeps nearly all pairs at
t = 0.9 also keeps about half of all pairs of a 64-dimensional sphere, so lists
of collisions would be longer than the list of all pairs. Counts are therefore
held for a block pair at a time and never written out.
"""

from __future__ import annotations

from functools import lru_cache
from math import lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import Forest, components, cut, grouped

#: Rows the main direction is taken from (its choice affects speed alone).
DIRECTION_ROWS = 4096
#: Vectors of a block: a twelfth of all within these bounds.
LEAST_BLOCK, MOST_BLOCK = 1024, 8192


def usable(v: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def kind_of(df: DataFrame, vector: str) -> str:
    """numpy type of the vectors' components as stored."""
    return "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"


def as_bytes(df: DataFrame, vector: str, columns: str) -> DataFrame:
    """Replace ``vector`` by ``v``, its components' bytes. columns: DDL of the other columns."""
    kind, names = kind_of(df, vector), [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            out = b[names].copy()
            out["v"] = [np.asarray(x, kind).tobytes() for x in b[vector]]
            yield out

    return df.select(*names, vector).mapInPandas(run, columns + ", v binary")


@lru_cache(maxsize=64)
def plan(d: int, threshold: float, projections: int, miss: float) -> tuple[np.ndarray, float, int]:
    """Directions (d x projections), half a window's width, least count.

    The window is two usual differences of a pair at the threshold wide on
    either side: of the widths that one count serves, this parts random pairs
    best at 64 dimensions.
    """
    rng = np.random.default_rng(d * 7919 + projections)
    a = rng.standard_normal((d, projections))
    a /= np.linalg.norm(a, axis=0)
    far = sqrt(max(0.0, 2 - 2 * threshold))
    width = 2 * far / sqrt(d) + 1e-9
    if width >= far:  # up to four dimensions every pair at the threshold collides along every direction
        return a, width, projections
    u = np.linspace(-1, 1, 200_001)[1:-1]
    p = (1 - u * u) ** ((d - 3) / 2)
    near = p[np.abs(u) * far <= width].sum() / p.sum()
    chance, least = 0.0, 0
    for k in range(projections):
        chance += np.exp(lgamma(projections + 1) - lgamma(k + 1) - lgamma(projections - k + 1) + k * log(near) + (projections - k) * log(1 - near))
        if chance > miss:
            break
        least = k + 1
    return a, width, least


def _linked(x: np.ndarray, y: np.ndarray, same: bool, threshold: float, projections: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs (x, y) with cosine >= threshold, each once. Rows are unit vectors, 65,535 of y at most."""
    directions, width, least = plan(x.shape[1], threshold, projections, miss)
    p, q = x @ directions, y @ directions
    order = np.argsort(q, axis=0, kind="stable")
    rank = np.empty(q.shape, np.uint16)
    np.put_along_axis(rank, order, np.arange(len(y), dtype=np.uint16)[:, None], 0)
    sorted_q = np.take_along_axis(q, order, 0)
    low, size = np.empty(p.shape, np.uint16), np.empty(p.shape, np.uint16)
    for k in range(p.shape[1]):  # each query's window in the order along this direction
        low[:, k] = a = np.searchsorted(sorted_q[:, k], p[:, k] - width, "left")
        size[:, k] = np.searchsorted(sorted_q[:, k], p[:, k] + width, "right") - a
    rank, low, size = np.ascontiguousarray(rank.T), low.T, size.T
    got: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), 64):
        base = at if same else 0
        here = rank[:, base:]
        n = min(64, len(x) - at)
        hits = np.zeros((n, here.shape[1]), np.uint8)
        place, inside = np.empty(hits.shape, np.uint16), np.empty(hits.shape, bool)
        for r, lo, many in zip(here, low[:, at : at + n], size[:, at : at + n], strict=True):
            np.subtract(r[None, :], lo[:, None], out=place)  # ranks below the window wrap around to large numbers
            np.less(place, many[:, None], out=inside)
            np.add(hits, inside.view(np.uint8), out=hits)
        i, j = np.divmod(np.flatnonzero(hits.ravel() >= least), hits.shape[1])
        i, j = i + at, j + base
        if same:
            i, j = i[j > i], j[j > i]
        for s in range(0, len(i), 65536):
            a, b = i[s : s + 65536], j[s : s + 65536]
            good = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            got.append((a[good], b[good]))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def near_duplicates(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, projections: int = 40, miss: float = 1e-7, block: int | None = None) -> DataFrame:
    """One row a row of ``vectors``: id, n_links, component_id, kept.

    n_links counts the other rows with cosine >= threshold; component_id is the
    smallest id reachable by links. Null, zero and non-finite vectors, vectors
    of different lengths and an empty table link nothing: n_links 0, the row's
    own id. Repeated rows count each; a null id is linked and counted but never
    the smallest, and its row is not kept. Other columns are ignored. ``block``
    is the number of vectors in a block; the driver gets two numbers a block.
    """
    kind = kind_of(vectors, vector)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).withColumn("ok", usable(F.col("v")))
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v"))
    own = rows.where("ok").groupBy("h", "g").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    kept = cut(as_bytes(own, "v", "h long, g long, least long, copies long"))
    kept = kept.withColumn("c", F.monotonically_increasing_id())
    n, widest = kept.agg(F.count("*"), F.max(F.length("v"))).first()
    if not n:
        return vectors.select(id, F.lit(0).cast("long").alias("n_links"), F.col(id).cast("long").alias("component_id"), F.col(id).isNotNull().alias("kept"))
    some = [np.frombuffer(r[0], kind).astype("f8") for r in kept.where(F.length("v") == widest).orderBy("h").limit(DIRECTION_ROWS).select("v").collect()]
    some = np.array([x / np.linalg.norm(x) for x in some])
    main = np.linalg.eigh(some.T @ some - len(some) * np.outer(some.mean(0), some.mean(0)))[1][:, -1]

    def along(v: pd.Series) -> pd.Series:
        out = []
        for b in v:
            x = np.frombuffer(b, kind).astype("f8")
            out.append(float(x @ main / np.linalg.norm(x)) if len(x) == len(main) else 0.0)
        return pd.Series(out, dtype="f8")

    position = F.pandas_udf(along, "double")
    blocks = max(1, -(-n // (block or min(MOST_BLOCK, max(LEAST_BLOCK, n // 12)))))
    parts = kept.select("c", "copies", "v", position("v").alias("p")).repartitionByRange(blocks, "p", "c")
    dealt = cut(parts.withColumn("block", F.spark_partition_id()))
    bounds = dealt.groupBy("block").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("block").toPandas()  # a row a block
    far = sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    # blocks are ranges of one order, so those that a block meets are neighbours of it
    last = np.searchsorted(bounds["lo"], bounds["hi"] + far, "right") - 1
    first = np.searchsorted(last, np.arange(len(bounds)), "left")
    number = bounds["block"].to_numpy()
    reach = dealt.sparkSession.createDataFrame(pd.DataFrame({"block": number, "at": np.arange(len(bounds)), "first": first, "last": last}), "block int, at int, first int, last int")
    each = dealt.join(reach, "block").withColumn("other", F.explode(F.sequence("first", "last")))
    each = each.select("c", "copies", "v", F.col("at").alias("block"), F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b"))

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        rows_out = []
        for _, f in g.groupby(g["v"].str.len()):
            here = f["block"].to_numpy()
            a, b = int(f["a"].iloc[0]), int(f["b"].iloc[0])
            x = np.stack([np.frombuffer(v, kind) for v in f["v"]]).astype("f8")
            x /= np.linalg.norm(x, axis=1)[:, None]
            left, right = np.flatnonzero(here == a), np.flatnonzero(here == b)
            if not len(left) or not len(right):
                continue
            i, j = _linked(x[left], x[right], a == b, threshold, projections, miss)
            i, j = left[i], right[j]
            if not len(i):
                continue
            ids, copies = f["c"].to_numpy(), f["copies"].to_numpy()
            links = np.bincount(i, copies[j], len(f)) + np.bincount(j, copies[i], len(f))
            some_links = np.flatnonzero(links)
            rows_out.append(pd.DataFrame({"a": ids[some_links], "b": -1, "links": links[some_links].astype("i8")}))
            forest = Forest(len(f))
            tree = [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]
            rows_out.append(pd.DataFrame({"a": ids[[t[0] for t in tree]], "b": ids[[t[1] for t in tree]], "links": 0}))
        return pd.concat(rows_out) if rows_out else None

    found = cut(grouped(each, ["a", "b"], compare, "a long, b long, links long"))
    links = found.where("b < 0").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "c")
    comp = components(found.where("b >= 0").select("a", "b")).withColumnRenamed("node", "c")
    classes = kept.select("c", "h", "g", "least", "copies").join(links, "c", "left").join(comp, "c", "left").withColumn("component", F.coalesce("component", "c"))
    classes = cut(classes)
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("h", "g", F.lit(True).alias("ok"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    full = rows.select("id", "ok", "h", "g").join(classes, ["h", "g", "ok"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id"))
    return full.select(F.col("id").alias(id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
