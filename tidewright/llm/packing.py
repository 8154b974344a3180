"""Harmonic packing of token sequences into fixed-size training sequences.

Lengths fall into reciprocal-capacity classes: class k takes pieces of length
in (C/(k+1), C/k], and each of its bins holds exactly k of them. A worker fills
the bins of each class on its own, with no knowledge of other workers. Since
documents may be cut, a document gives as many whole sequences as it has, and
its rest is cut to the largest reciprocal sizes floor(C/k) down to a short end;
so bins of k pieces are full but for C mod k tokens, or C/17 for short ends.

What doesn't fill a bin (fewer than k pieces a class and worker) moves up a
tree: groups of ``FAN`` workers' leftovers are filled again by the same rule,
until one group is left; its at most ~5,000 pieces (a constant: the sum over
the classes of k-1) are packed first-fit-decreasing. Nothing that grows with
the data meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import cut, small_batches
from tidewright.llm.tokens import encoder

FAN = 64
PIECE = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECE + ", sequence_id long, offset long"
#: A sequence id is a node of the tree of workers, then a counter there.
SHIFT = 36


def sizes(total: int, capacity: int, least: int) -> list[int]:
    """Lengths of the pieces of a document of ``total`` tokens, in order."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest > least:
        piece = capacity // -(-capacity // rest)  # the largest floor(C/k) that fits
        out.append(piece)
        rest -= piece
    return [*out, rest] if rest else out


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, place in it, filled): k pieces of class k a bin, those over without a bin."""
    k = capacity // lengths
    order = np.argsort(k, kind="stable")
    ks = k[order]
    first = np.searchsorted(ks, ks, "left")
    rank = np.arange(len(ks)) - first
    count = np.searchsorted(ks, ks, "right") - first
    full = rank < count // ks * ks
    starts = np.flatnonzero(full & (rank % ks == 0))
    number = np.cumsum(full & (rank % ks == 0)) - 1
    size = lengths[order]
    ahead = np.cumsum(size) - size
    offset = np.where(full, ahead - ahead[starts][np.maximum(number, 0)] if len(starts) else 0, 0)
    bins, places, filled = np.empty(len(k), np.int64), np.empty(len(k), np.int64), np.empty(len(k), bool)
    bins[order], places[order], filled[order] = number, offset, full
    return bins, places, filled


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place) by first-fit-decreasing, for the bounded rest."""
    used: list[int] = []
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        at = next((b for b, u in enumerate(used) if u + lengths[i] <= capacity), len(used))
        if at == len(used):
            used.append(0)
        bins[i], places[i] = at, used[at]
        used[at] += int(lengths[i])
    return bins, places


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, least: int, with_ids: bool) -> DataFrame:
    """Tokenise and cut: one row a piece. ``row`` tells rows of one doc_id apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, row = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << SHIFT
        for batch in batches:
            out, blobs = [], []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw, start = enc.raw(text) + end, 0
                total = len(raw) // 4
                for n in sizes(total, capacity, least):
                    part = raw[4 * start : 4 * (start + n)]
                    out.append((doc, row, start, n, zlib.crc32(part), total))
                    blobs.append(part) if with_ids else None
                    start += n
                row += 1
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in PIECE.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            if with_ids:
                frame["ids"] = blobs
            yield frame

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, PIECE + (", ids binary" if with_ids else ""))


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (any columns besides ``length``).

    Sequence ids are unique, not consecutive: a worker's number and a counter.
    """
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def level(frame_in: DataFrame, depth: int, last: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            base = (depth << 58) + (TaskContext.get().partitionId() << SHIFT)
            held: list[pd.DataFrame] = []
            used = 0
            for batch in batches:
                if not len(batch):
                    continue
                frame = pd.concat([*held, batch], ignore_index=True)
                bins, places, filled = fill(frame["length"].to_numpy(), capacity)
                done = frame[filled].copy()
                done["sequence_id"], done["offset"] = base + used + bins[filled], places[filled]
                used += int(bins[filled].max()) + 1 if filled.any() else 0
                held = [frame[~filled]]
                if len(done):
                    yield done
            if held and len(held[0]):
                left = held[0].copy()
                if last:
                    bins, places = first_fit(left["length"].to_numpy(), capacity)
                    left["sequence_id"], left["offset"] = base + used + bins, places
                else:
                    left["sequence_id"], left["offset"] = -1, -1
                yield left

        return frame_in.mapInPandas(run, plain + ", sequence_id long, offset long")

    out, depth, rest, width = None, 0, pieces, None
    while width != 1:
        now = cut(level(rest, depth, False))
        done = now.where("sequence_id >= 0")
        out = done if out is None else out.unionByName(done)
        width = -(-now.rdd.getNumPartitions() // FAN)
        rest = now.where("sequence_id < 0").drop("sequence_id", "offset").coalesce(max(1, width))
        depth += 1
        if width <= 1:
            break
    return out.unionByName(level(rest, depth, True))


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 0, capacity: int = 1024, least: int = 64, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences.

    docs: doc_id, text, other columns are ignored. A null text is empty and
    gives its end id alone; null and repeated doc_ids are kept, told apart by
    ``row``; an empty table gives no rows. ``with_ids`` adds the piece's ids
    (little-endian unsigned 32-bit), which ``sequences`` joins.
    """
    return place(cut_pieces(docs, tokenizer, end_id, capacity, least, with_ids), capacity)


def sequences(placed: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """Whole sequences: sequence_id, ids binary (padded to the capacity, but at a power of two), doc_ids and offsets of the pieces, n_tokens."""
    got = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    used = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    ids = F.aggregate("p", F.unhex(F.lit("")), lambda b, x: F.concat(b, x["ids"]))
    short = F.when(used.bitwiseAND(used - 1) == 0, 0).otherwise(F.lit(capacity) - used).cast("int")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), short))
    return got.select("sequence_id", F.concat(ids, pad).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"), used.alias("n_tokens"))
