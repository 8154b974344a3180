"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only on one machine (a local master, tests) and where
    ``spark.checkpoint.dir`` is unset does a temporary folder stand in for it; a
    cluster's session must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers take ``rows`` rows at a time, so that long texts don't fill them.

    A setting of the session, which it keeps; a smaller one of the user's stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path, for ``removed``.

    For loops: unlike a checkpoint's, its size is known from its files, where
    sizes carried over from round to round would multiply.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """Apply ``fn`` to each group of ``keys``, many small groups a batch.

    Unlike applyInPandas there is no Arrow batch a group: rows are sorted in
    their partition and groups are cut out of the stream, so a group costs one
    slice. A group must fit one task; callers bound their groups.
    """
    names = list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(frame: pd.DataFrame) -> list[pd.DataFrame]:
            k = frame[keys]
            edge = np.flatnonzero((k.values[1:] != k.values[:-1]).any(axis=1)) + 1
            cuts = np.concatenate([[0], edge, [len(frame)]])
            found = (fn(frame.iloc[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            return [x for x in found if x is not None and len(x)]

        for batch in batches:
            if not len(batch):
                continue
            last = batch[keys].values[-1]
            same = (batch[keys].values == last).all(axis=1)
            # rows of the last key are at the end, as rows are sorted by key
            head = int(np.argmax(same))
            if head == 0 and (not held or (held[-1][keys].values[-1] == last).all()):
                held.append(batch)
                continue
            ready = pd.concat([*held, batch.iloc[:head]]) if held else batch.iloc[:head]
            held = [batch.iloc[head:]]
            if len(ready) and (out := flush(ready)):
                yield pd.concat(out, ignore_index=True)
        if held and (out := flush(pd.concat(held))):
            yield pd.concat(out, ignore_index=True)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))
    return dealt.select(*names).mapInPandas(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: (node, component = smallest id).

    Alternating large-star and small-star rounds (Kiveris et al., 2014), with
    the smallest neighbour as an aggregate that combines before the shuffle and
    plain joins, which adaptive execution splits at hubs. The edge set is
    written to the shared folder each round; rounds grow with the logarithm
    of the number of nodes. No collection of links on the driver.
    """
    spark = edges.sparkSession
    edges, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    state = edges.agg(*mark).first()
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges, now = written(small)
        removed(spark, path)
        path, before, state = now, state, edges.agg(*mark).first()
        if state == before:
            break
    stars = edges.groupBy("a").agg(F.min("b").alias("b"))
    out = cut(stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct()))
    removed(spark, path)
    return out


_held: dict = {}


def held(name, make: Callable):
    """What a worker process remembers between tasks, of one operator at a time.

    Workers live on from stage to stage, so each operator's memory would stay
    beside the next one's.
    """
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Drop what a worker process remembers, and give the pages back to the system."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's alone
        ctypes.CDLL(None).malloc_trim(0)


class Forest:
    """Union-find over small integers, smallest member as root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
