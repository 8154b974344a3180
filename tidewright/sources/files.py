"""Readers and writers: authored JSON, JSON lines, verified manifests, atomic publishing."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def authored(spark: SparkSession, where: str, schema: str) -> DataFrame:
    """Multi-line JSON objects, one a file, with the path they came from. Wrong types fail the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(where).withColumn("_path", F.col("_metadata.file_path"))


def json_lines(spark: SparkSession, where: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no object of the schema has its text in ``_bad``."""
    raw = spark.read.text(where)
    got = F.from_json("value", f"struct<{schema}, _bad string>", {"columnNameOfCorruptRecord": "_bad"})
    return raw.select(got.alias("r"), "value").select("r.*", F.when(F.col("r").isNull(), F.col("value")).alias("_none")).withColumn("_bad", F.coalesce("_bad", "_none")).drop("_none")


def canonical_lines(df: DataFrame) -> DataFrame:
    """One column ``value``: compact JSON with sorted keys; null fields are left out."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def manifest(spark: SparkSession, where: str) -> list[dict]:
    """Name, bytes, lines and SHA-256 of each file in ``where``, in name order; streamed by the executors, a file at a time in pieces."""
    files, root = _at(where)
    names = sorted(f.base_name for f in files.get_file_info(pafs.FileSelector(root)) if f.is_file)  # a name a file

    def run(batches):
        files, root = _at(where)
        for batch in batches:
            for name in batch["name"]:
                size, rows, digest = 0, 0, hashlib.sha256()
                with files.open_input_stream(f"{root}/{name}") as f:
                    while part := f.read(1 << 22):
                        size, rows = size + len(part), rows + part.count(b"\n")
                        digest.update(part)
                yield pd.DataFrame({"name": [name], "bytes": [size], "rows": [rows], "sha256": [digest.hexdigest()]})

    if not names:
        return []
    each = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names), 10_000))
    found = each.mapInPandas(run, "name string, bytes long, rows long, sha256 string")
    return [r.asDict() for r in found.orderBy("name").collect()]  # a row a file


def _at(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(where if "://" in where else f"file://{where}")


def verify(spark: SparkSession, where: str, told: list[dict]) -> list[str]:
    """What differs between a manifest and the files; empty if nothing does."""
    found = {r["name"]: r for r in manifest(spark, where)}
    want = {r["name"]: r for r in told}
    out = [f"{n}: missing" for n in sorted(want.keys() - found.keys())] + [f"{n}: not listed" for n in sorted(found.keys() - want.keys())]
    return out + [f"{n}: {k}" for n in sorted(want.keys() & found.keys()) for k in ("bytes", "rows", "sha256") if want[n][k] != found[n][k]]


def aggregate_sha256(spark: SparkSession, where: str, told: list[dict]) -> str:
    """SHA-256 of the bytes of a manifest's files one after another, in its order; streamed by one task, as a digest of ordered bytes must be."""
    names = [r["name"] for r in told]

    def run(batches):
        for _ in batches:
            files, root = _at(where)
            whole = hashlib.sha256()
            for name in names:
                with files.open_input_stream(f"{root}/{name}") as f:
                    while part := f.read(1 << 22):
                        whole.update(part)
            yield pd.DataFrame({"sha256": [whole.hexdigest()]})

    return spark.range(1, numPartitions=1).mapInPandas(run, "sha256 string").first()[0]


def manifest_scan(spark: SparkSession, where: str, told: list[dict], schema: str) -> DataFrame:
    """JSON lines of the files that a manifest lists, in its order: ``shard`` is the file's place. A file that is missing fails the read."""
    names = [r["name"] for r in told]
    if len(set(names)) < len(names):
        raise ValueError("the manifest lists a file twice")
    if not names:
        return spark.createDataFrame([], f"{schema}, shard int")
    rows = spark.read.schema(schema).json([f"{where}/{n}" for n in names])
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, shard int")  # a row a file
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return rows.withColumn("_name", name).join(order.withColumnRenamed("name", "_name"), "_name").drop("_name")


def routed(df: DataFrame, tag: str, current: str, legacy: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the current schema tag and of the older ones; any other tag, or none, fails when the rows are read."""
    known = F.coalesce(F.col(tag).isin(current, *legacy), F.lit(False))
    told = F.concat(F.lit("unknown schema tag: "), F.coalesce(F.col(tag), F.lit("none")))
    checked = df.withColumn(tag, F.when(known, F.col(tag)).otherwise(F.raise_error(told)))
    return checked.where(F.col(tag) == current), checked.where(F.col(tag) != current)


def recordings(spark: SparkSession, where: str) -> DataFrame:
    """Exported recordings, one JSON file each, that have a known version and frames; a row a frame."""
    frame = "struct<at:bigint, text:string, source:string>"
    got = spark.read.schema(f"version int, session string, frames array<{frame}>").option("multiLine", True).json(where)
    good = got.where(F.col("version").isin(1, 2) & (F.size("frames") > 0))
    return good.select("version", "session", F.posexplode("frames").alias("frame", "f")).select("version", "session", "frame", "f.*")


def _replace(spark: SparkSession, text: str, where: str) -> None:
    """Put a small file in the place of another by one rename, so a reader sees the old or the new one."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    target, aside = path(where), path(f"{where}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if "://" in where else path(f"file://{where}").toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, over)


def report(spark: SparkSession, value: dict, where: str) -> None:
    """A JSON report, whole or not at all."""
    _replace(spark, json.dumps(value, ensure_ascii=False, indent=2) + "\n", where)


def merged_state(spark: SparkSession, update: dict, where: str) -> dict:
    """A run's state file with ``update`` laid over it; one writer at a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    state = (json.loads("\n".join(r[0] for r in spark.read.text(where).collect())) if there else {}) | update  # a small file
    report(spark, state, where)
    return state


def publish(df: DataFrame, where: str) -> str:
    """Write a new version beside the old ones, then point ``CURRENT`` to it by one rename over the old pointer.

    A failed write leaves the old version current and its own files deleted.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{version}")
    try:
        df.write.json(f"{where}/{version}")
    except Exception:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        raise
    _replace(spark, json.dumps({"version": version}), f"{where}/CURRENT")
    return version


def current(spark: SparkSession, where: str, schema: str) -> DataFrame:
    """The version that ``CURRENT`` names."""
    version = json.loads(spark.read.text(f"{where}/CURRENT").first()[0])["version"]
    return spark.read.schema(schema).json(f"{where}/{version}")
