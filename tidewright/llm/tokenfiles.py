"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped.

A set of files holds, for each part, ``part-N.bin`` (ids of all documents, one
after another, little-endian, as the narrowest unsigned type that holds the
vocabulary) and ``part-N.idx`` (a row a document of three 64-bit integers: its
id, 1 if it has one, its first id's place in the whole set), and a manifest
with each part's base. Parts are ranges of doc_id; the bases are prefix sums
of the parts' counts. Files are written under names of the attempt and then
renamed, so a task that runs again replaces its own file by the same bytes.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import small_batches
from tidewright.llm.tokens import encoder

BLOCK = 1 << 20


def _open(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(where)


def _dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Smallest doc_ids of all parts but the first, from the column's quantiles: a number a part comes to the driver."""
    if parts < 2:
        return np.zeros(0, "i8")
    share = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), share, max(10_000, 4 * parts))).first()[0]
    return np.array(found or [], "i8")


def _parts(docs: DataFrame) -> int:
    """As many parts as the session shuffles to, or more, so that none is made from over some 128 MB of stored input.

    Tables of unknown size (estimates beyond 2^52 bytes) get the session's number.
    """
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return least if stored >= 1 << 52 else max(least, min(100_000, -(-stored // (128 << 20))))


def write(docs: DataFrame, where: str, tokenizer: str, *, end_id: int = 0, vocabulary: int = 50_257) -> dict:
    """Write ``docs`` (doc_id, text, others are ignored) in ascending doc_id order; the manifest.

    A null text is empty (its end id alone). Null doc_ids come first; rows of
    one doc_id are in one part and follow one another by their ids. An empty
    table gives no parts. Texts are encoded where they are read, and their ids
    (of the files' width) are dealt by ranges of doc_id, so a part is a slice of
    the order; a part's writer holds some rows' ids, never all at once. One
    text is held whole, however long.
    """
    dtype = _dtype(vocabulary)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_parts = _parts(docs)
    bounds = _bounds(docs, n_parts)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        narrow = (lambda raw: np.frombuffer(raw, "<u4").astype(dtype).tobytes()) if dtype != "<u4" else bytes
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            part = np.searchsorted(bounds, ids.fillna(-(1 << 63)).to_numpy("i8"), "right")
            yield pd.DataFrame({"part": part.astype("i4"), "doc_id": ids, "ids": [narrow(enc.raw(t) + end) for t in batch["text"]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, root = _open(where)
        wide, n, docs_seen = np.dtype(dtype).itemsize, 0, 0
        names = [(f"{root}/.part-{part:05d}.{x}.{attempt}", f"{root}/part-{part:05d}.{x}") for x in ("bin", "idx")]
        ids_file = index = None
        for batch in batches:
            if not len(batch):
                continue
            if ids_file is None:
                ids_file, index = files.open_output_stream(names[0][0]), files.open_output_stream(names[1][0])
            size = batch["ids"].str.len().to_numpy("i8") // wide
            ids = batch["doc_id"].astype("Int64")
            rows = np.stack([ids.fillna(0).to_numpy("i8"), ids.notna().to_numpy("i8"), n + np.cumsum(size) - size], axis=1).astype("<i8")
            n += int(size.sum())
            ids_file.write(b"".join(batch["ids"]))
            index.write(rows.tobytes())
            docs_seen += len(batch)
        if ids_file is not None:
            ids_file.close()
            index.close()
            for old, new in names:
                files.move(old, new)
            yield pd.DataFrame({"part": [part], "n_docs": [docs_seen], "n_ids": [n]})

    small_batches(docs.sparkSession)
    files, root = _open(where)
    files.create_dir(root, recursive=True)
    coded = docs.mapInPandas(encode, "part int, doc_id long, ids binary").repartitionById(n_parts, F.col("part"))
    counts = coded.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids").mapInPandas(run, "part long, n_docs long, n_ids long")
    # a row a part, of some 128 MB each
    parts, base = [], 0
    for part, n_docs, n_ids in sorted(map(tuple, counts.collect())):
        parts.append({"part": part, "n_docs": n_docs, "n_ids": n_ids, "base": base})
        base += n_ids
    manifest = {"version": 1, "dtype": dtype, "n_ids": base, "parts": parts}
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def manifest_of(where: str) -> dict:
    files, root = _open(where)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class _Numbers:
    """A file's numbers by slices: mapped into memory where the file system is local, else read in ranges."""

    def __init__(self, files: pafs.FileSystem, path: str, dtype: str) -> None:
        self.dtype = np.dtype(dtype)
        local = isinstance(files, pafs.LocalFileSystem)
        self.mapped = np.memmap(path, self.dtype, "r") if local and files.get_file_info(path).size else None
        self.file = None if local else files.open_input_file(path)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.file is None:
            return np.zeros(0, self.dtype) if self.mapped is None else self.mapped[at]
        wide = self.dtype.itemsize
        self.file.seek(at.start * wide)
        return np.frombuffer(self.file.read((at.stop - at.start) * wide), self.dtype)


def read(spark: SparkSession, where: str, with_ids: bool = False) -> DataFrame:
    """A row a document: doc_id, start (over the whole set), n_tokens, ids_crc32, and ids if asked for.

    Each task maps one part; ``start`` is the part's base plus its offset. Ids
    are read a million at a time (a longer document at once).
    """
    manifest = manifest_of(where)
    parts, dtype = manifest["parts"], manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _open(where)
        for at in (x for batch in batches for x in batch["id"]):
            p = parts[at]
            ids = _Numbers(files, f"{root}/part-{p['part']:05d}.bin", dtype)
            index = _Numbers(files, f"{root}/part-{p['part']:05d}.idx", "<i8")
            for a in range(0, p["n_docs"], 4096):
                b = min(a + 4096, p["n_docs"])
                rows = np.asarray(index[3 * a : 3 * b]).reshape(-1, 3)
                last = int(index[3 * b : 3 * b + 3][2]) if b < p["n_docs"] else p["n_ids"]
                ends, i = np.append(rows[1:, 2], last), 0
                while i < len(rows):
                    j = max(i + 1, int(np.searchsorted(ends, rows[i, 2] + BLOCK, "right")))
                    begin = int(rows[i, 2])
                    raw = memoryview(np.asarray(ids[begin : int(ends[j - 1])]).astype("<u4").tobytes())
                    cuts = ((rows[i:j, 2] - begin) * 4).tolist(), ((ends[i:j] - begin) * 4).tolist()
                    blobs = [raw[x:y] for x, y in zip(*cuts, strict=True)]
                    out = pd.DataFrame({"doc_id": pd.array(rows[i:j, 0], "Int64"), "start": rows[i:j, 2] + p["base"], "n_tokens": ends[i:j] - rows[i:j, 2], "ids_crc32": [zlib.crc32(x) for x in blobs]})
                    out.loc[rows[i:j, 1] == 0, "doc_id"] = pd.NA
                    if with_ids:
                        out["ids"] = [bytes(x) for x in blobs]
                    yield out
                    i = j

    return spark.range(0, len(parts), 1, len(parts)).mapInPandas(run, schema)


def fresh(root: str) -> str:
    """A new folder's address below ``root``."""
    return f"{root.rstrip('/') if '://' in root else 'file://' + root.rstrip('/')}/token-ids-{uuid.uuid4().hex}"
