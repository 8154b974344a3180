"""Documents whose word-shingle sets have a Jaccard similarity of 0.8 or more.

Chosen-path join. Equal sets are one class from the start. In each of several
runs a class follows paths: at each level it samples a few of its shingles by
hashes that all classes share, so similar sets sample the same ones, and each
sampled shingle extends the path. Classes with the same path form a bucket. A
bucket of few members, or one whose members are alike on the whole (more paths
would not part them), is a leaf and is compared by brute force; others are split
again by the next level's samples. A pair of similarity s shares a sample at one
level with probability 1 - exp(-RATE s) at least, so it shares a leaf at level L
of one of R runs with 1 - (1 - (1 - exp(-RATE s))^L)^R; runs are repeated until
that reaches the target.

Brute force has two steps: 128 one-bit minwise sketches and sizes rule out pairs
in numpy blocks; for what remains the texts are fetched and sets intersected
exactly. A pair is counted in the first leaf it shares only, and a task returns
link counts and a spanning forest, so no group's pairs are written out.
"""

from __future__ import annotations

import re
from math import exp

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import Forest, components, cut, grouped, held, small_batches
from tidewright.llm.linededup import NO_ID

WORD = re.compile(r"\w+")
RATE, LEVELS = 3.5, 4
#: A bucket over LIMIT members is split, unless its mean similarity is ALIKE or more.
LIMIT, ALIKE = 2048, 0.4
#: Members of a block in brute force by sketches.
BLOCK = 1024
BITS = 128
#: Sketch bits that must agree: a pair of similarity 0.8 has fewer with probability below 1e-8.
AGREE = 94

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = np.random.default_rng(5).integers(1 << 40, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: lower-cased runs of word characters.

    A text of fewer words than a shingle has one shingle of them all; one
    without words has none.
    """
    found = WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    known = held("shingle words", dict)
    if len(known) > 150_000:
        known.clear()
    try:
        h = [known[w] for w in found]
    except KeyError:
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(found).difference(known))
        h = [known[w] for w in found]
    h = np.array(h, np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketch(x: np.ndarray) -> bytes:
    """One bit of each of 128 minima."""
    least = np.full(BITS, np.iinfo(np.uint64).max)
    for a in range(0, len(x), 1024):
        np.minimum(least, (x[a : a + 1024, None] * _FACTORS).min(axis=0), out=least)
    return np.packbits((mix(least) & np.uint64(1)).astype(np.uint8)).tobytes()


def samples(x: np.ndarray, runs: int) -> list[int]:
    """Sampled shingles of all runs and levels: run, level and shingle in one 64-bit path step.

    The last 8 bits hold run and level; the rest is the shingle's hash. A run
    mixes each shingle once; a level looks at 16 bits of its own.
    """
    if not len(x):
        return []
    edge, out = min(1 << 16, -(-int(RATE * 65536) // len(x))), []
    for r in range(runs):
        u = mix(x + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at, level = np.nonzero(u.view(np.uint16).reshape(-1, 4)[:, :LEVELS] < edge)
        out.append((mix(u[at] + level.astype(np.uint64)) & ~np.uint64(255)) | (np.uint64(4 * r) + level.astype(np.uint64)))
    return np.concatenate(out).view(np.int64).tolist()


def runs_for(recall: float, threshold: float, levels: int = LEVELS) -> int:
    """Runs that a pair at the threshold needs for the recall, were it split at every level."""
    once, miss, runs = (1 - exp(-RATE * threshold)) ** levels, 1.0, 0
    while miss > 1 - recall:
        miss, runs = miss * (1 - once), runs + 1
    return runs


def _agreeing(bits: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of the pairs that sketches and sizes leave."""
    a, b = bits[left].astype(np.float32), bits[right].astype(np.float32)
    ok = a @ b.T >= 2 * AGREE - BITS  # bits are -1 and 1
    s, t = size[left][:, None], size[right][None, :]
    return ok & (np.minimum(s, t) >= threshold * np.maximum(s, t))


def _elsewhere(paths: list[np.ndarray], path: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix of the pairs that share a leaf before this one, by the paths' 64 bits."""
    who = np.concatenate([np.full(len(p), i) for i, p in enumerate(paths)])
    at = np.concatenate(paths)
    who, at = who[at < path], at[at < path]
    _, col, many = np.unique(at, return_inverse=True, return_counts=True)
    keep = many[col] > 1
    who, col = who[keep], col[keep]
    out = np.zeros((len(left), len(right)), bool)
    if not len(col):
        return out
    _, col = np.unique(col, return_inverse=True)
    for a in range(0, int(col.max()) + 1, 2048):
        m = np.zeros((len(paths), 2048), np.float32)
        pick = (col >= a) & (col < a + 2048)
        m[who[pick], col[pick] - a] = 1
        out |= m[left] @ m[right].T > 0
    return out


def _compare(threshold: float, exact: bool, words: int):
    """The kernel of a block pair of a leaf: candidates (sketches) or links (texts)."""

    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        a, b, path = int(g["a"].iloc[0]), int(g["b"].iloc[0]), int(g["path"].iloc[0])
        block = g["block"].to_numpy()
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        if not len(left) or not len(right) or len(g) < 2:
            return None
        size = g["size"].to_numpy()
        if not exact:
            bits = np.unpackbits(np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), -1), axis=1).astype(np.int8) * 2 - 1
            ok = _agreeing(bits, size, left, right, threshold)
        else:
            sets = [shingles(t, words) for t in g["text"]]
            common = _common(sets, left, right)
            union = size[left][:, None] + size[right][None, :] - common
            ok = common >= threshold * union
        if a == b:
            ok = np.triu(ok, 1)
        if not ok.any():
            return None
        ok &= ~_elsewhere([np.asarray(p, np.int64) for p in g["leaves"]], path, left, right)
        i, j = np.nonzero(ok)
        if not len(i):
            return None
        i, j = left[i], right[j]
        if not exact:
            return g.iloc[np.unique(np.concatenate([i, j]))][["path", "n", "c", "size", "copies", "leaves"]]
        ids, copies = g["c"].to_numpy(), g["copies"].to_numpy()
        links = np.bincount(i, copies[j], len(g)) + np.bincount(j, copies[i], len(g))
        some, forest = np.flatnonzero(links), Forest(len(g))
        tree = [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]
        return pd.concat([pd.DataFrame({"a": ids[some], "b": -1, "links": links[some].astype("i8")}), pd.DataFrame({"a": ids[[t[0] for t in tree]], "b": ids[[t[1] for t in tree]], "links": 0})])

    return run


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set."""
    if len(left) * len(right) <= 36:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, who = flat[order], who[order]
    col = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    keep = np.bincount(col)[col] > 1
    who, col = who[keep], col[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    if len(col):
        _, col = np.unique(col, return_inverse=True)
        edges = np.searchsorted(col, np.arange(0, col[-1] + 4097, 4096))
        for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            m = np.zeros((len(sets), 4096), np.float32)
            m[who[x:y], col[x:y] - 4096 * k] = 1
            out += m[left] @ m[right].T
    return out.astype(np.int64)


def _alike(rows: DataFrame) -> DataFrame:
    """Mean similarity of each bucket's members: (path, alike), from sums of sketch bits."""

    def bits(f: pd.DataFrame) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(len(f), -1), axis=1)

    def part(batches):
        for b in batches:
            if len(b):
                got = [(p, len(f), bits(f).sum(0).astype("<i8").tobytes()) for p, f in b.groupby("path")]
                yield pd.DataFrame(got, columns=["path", "k", "ones"])

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        n, ones = float(g["k"].sum()), np.sum([np.frombuffer(x, "<i8") for x in g["ones"]], axis=0).astype("f8")
        same = (ones * (ones - 1) + (n - ones) * (n - ones - 1)).sum() / (BITS * n * (n - 1))
        return pd.DataFrame({"path": [g["path"].iloc[0]], "alike": [2 * same - 1]})

    return grouped(rows.select("path", "sketch").mapInPandas(part, "path long, k long, ones binary"), ["path"], whole, "path long, alike double")


def _paired(leaf: DataFrame, count: Column) -> DataFrame:
    """Deal a leaf's members to its block pairs; ``count`` gives the blocks for its n members."""
    own = leaf.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return own.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other", "blocks")


def near_duplicates(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row a row of ``docs``: doc_id, class_id, n_links, component_id, kept.

    class_id is the smallest doc_id with the same shingle set; n_links counts
    the other rows whose set has a Jaccard similarity of ``threshold`` or more;
    component_id is the smallest doc_id reachable by links; kept marks one row
    of each component, of the smallest doc_id (the first of repeated rows).
    Texts without words (null, empty) have equal sets, so they are one class.
    Null doc_ids take part and count as smaller than all others. An empty table
    gives no rows. Other columns are ignored.
    """
    return _resolve(docs, words, threshold, recall).select("doc_id", "class_id", "n_links", "component_id", "kept")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs``, one document of each component; others' rows are left out."""
    kept = near_rows(docs, **options).where("kept").select("d", "t").distinct()
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    own = own.withColumn("d", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID))).withColumn("t", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    return own.join(kept, ["d", "t"], "left_semi").dropDuplicates(["d", "t"]).select("row.*")


def near_rows(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """As near_duplicates, with the row's key (d, t): doc_id without nulls and the text's hash."""
    return _resolve(docs, words, threshold, recall)


def _resolve(docs: DataFrame, words: int, threshold: float, recall: float) -> DataFrame:
    small_batches(docs.sparkSession)
    runs = runs_for(recall, threshold)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")

    def describe(batches):
        for b in batches:
            out = []
            for d, t, text in zip(b["d"], b["t"], b["text"], strict=True):
                x = shingles(text, words)
                raw = xxhash.xxh3_128_digest(x.tobytes())
                out.append((d, t, int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True), len(x), sketch(x), samples(x, runs)))
            yield pd.DataFrame(out, columns=["d", "t", "h", "g", "size", "sketch", "steps"])

    rows = cut(keyed.mapInPandas(describe, "d long, t long, h long, g long, size long, sketch binary, steps array<long>"))
    rows = rows.withColumn("u", F.monotonically_increasing_id())
    first = F.min(F.struct("d", "u", "t"))
    classes = cut(rows.groupBy("h", "g").agg(first.alias("first"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"), F.any_value("steps").alias("steps")))
    classes = classes.withColumn("c", F.monotonically_increasing_id())
    step = lambda level: F.filter("steps", lambda s: s.bitwiseAND(F.lit(3)) == level)
    run_of = lambda s: F.shiftright(s.bitwiseAND(F.lit(255)), 2)

    live = classes.select("c", F.explode(step(0)).alias("path")).withColumn("run", run_of(F.col("path")))
    leaves: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        n = live.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        met = cut(live.join(n, "path"))
        leaves.append(met.where(F.col("n") <= LIMIT).select("c", "path", "n"))
        large = met.where(F.col("n") > LIMIT)
        if large.isEmpty():
            break
        wide = large.join(classes.select("c", "sketch", "steps"), "c")
        if level == LEVELS:
            leaves.append(large.select("c", "path", "n"))
            break
        alike = cut(_alike(wide))
        leaves.append(large.join(alike.where(F.col("alike") >= ALIKE), "path").select("c", "path", "n"))
        go_on = wide.join(alike.where(F.col("alike") < ALIKE), "path")
        more = F.filter(step(level), lambda s: run_of(s) == F.col("run"))
        live = go_on.select("c", "run", "path", F.explode(more).alias("s")).select("c", "run", F.xxhash64("path", "s").alias("path"))
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.union(x)
    leaf = leaf.distinct() if len(leaves) > 1 else leaf
    own = leaf.groupBy("c").agg(F.collect_list("path").alias("leaves"))
    members = leaf.join(own.join(classes.select("c", "size", "copies", "sketch"), "c"), "c").select("path", "n", "c", "size", "copies", "sketch", "leaves")
    columns = "path long, n long, c long, size long, copies long, leaves array<long>"
    maybe = cut(grouped(_paired(members, F.ceil(F.col("n") / BLOCK).cast("int")), ["path", "a", "b"], _compare(threshold, False, words), columns).distinct())
    texts = keyed.join(maybe.select("c").distinct().join(classes.select("c", "first.d", "first.t"), "c"), ["d", "t"]).dropDuplicates(["d", "t"]).select("c", "text")
    # exact comparison: blocks of 128 members, or 24 blocks and more where that would be over 24
    fine = F.least(F.ceil(F.col("n") / 128), F.greatest(F.lit(24), F.floor(F.col("n") / 1024))).cast("int")
    final = _paired(maybe.join(texts, "c"), fine)
    found = cut(grouped(final, ["path", "a", "b"], _compare(threshold, True, words), "a long, b long, links long"))
    links = found.where("b < 0").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "c")
    comp = components(found.where("b >= 0").select("a", "b")).withColumnRenamed("node", "c")
    told = cut(classes.select("c", "h", "g", "first", "copies").join(links, "c", "left").join(comp, "c", "left").withColumn("component", F.coalesce("component", "c")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1))
    chief = told.groupBy("component").agg(F.min("first").alias("chief"))
    told = told.join(chief, "component").select("h", "g", "first", "links", "chief")
    clean = lambda c: F.when(c != NO_ID, c)
    return rows.select("d", "t", "u", "h", "g").join(told, ["h", "g"]).select(clean(F.col("d")).alias("doc_id"), clean(F.col("first.d")).alias("class_id"), F.col("links").alias("n_links"), clean(F.col("chief.d")).alias("component_id"), (F.col("u") == F.col("chief.u")).alias("kept"), "d", "t")
