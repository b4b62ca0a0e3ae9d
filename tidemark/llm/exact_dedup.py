"""Exact deduplication by two-pass Bloom filtering.

Pass one sets, for every text, a few slots of a Bloom filter that remembers
"seen once" and "seen again".  Pass two asks it for every text: only a text
whose slots were all seen again can have an equal, and only those rows are
shuffled and grouped.  All other rows pass straight through, each its own group.

The filter has ``bits_per_row`` bits a row up to ``max_filter_bytes``.  That
bound is what makes it safe to collect and broadcast; a fuller filter lets more
rows into the shuffle (32-byte digests, never texts) and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import CHUNK_BITS, filter_bits, has, mark
from tidemark.llm.common import local_partitions, stage, text_or_empty

SLOTS = 3             # slots a digest sets


def _slots(digests: pa.Array, bits: int) -> np.ndarray:
    """Filter slots of each 32-byte digest, shape (rows, SLOTS)."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)
    return (raw[:, :SLOTS] % np.uint64(bits)).astype(np.int64)


def _build(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            slots, n = np.unique(_slots(batch.column("digest"), bits), return_counts=True)
            mark(again, slots[(n > 1) | has(once, slots)])
            mark(once, slots)
        step = CHUNK_BITS // 8
        used = np.flatnonzero(once.reshape(-1, step).any(axis=1))
        for at in range(0, len(used), 1024):
            ids = used[at:at + 1024]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()),
                 pa.array([once[i * step:(i + 1) * step].tobytes() for i in ids], pa.binary()),
                 pa.array([again[i * step:(i + 1) * step].tobytes() for i in ids], pa.binary())],
                ["chunk", "once", "again"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the pieces that tasks made of each chunk: again where two tasks saw it."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for chunk, once, again in zip(*(c.to_pylist() for c in batch.columns)):
            o, a = np.frombuffer(once, np.uint8), np.frombuffer(again, np.uint8)
            if chunk in held:
                old = held[chunk]
                old[1] |= a | (old[0] & o)
                old[0] |= o
            else:
                held[chunk] = [o.copy(), a.copy()]
    found = {k: v[1].tobytes() for k, v in held.items() if v[1].any()}
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())],
                                     ["chunk", "again"])


def repeated_filter(digests: DataFrame, rows: int, bits_per_row: int, max_filter_bytes: int) -> np.ndarray:
    """The packed "seen again" bitmap over all rows of ``digests``."""
    bits = filter_bits(rows, bits_per_row, max_filter_bytes)
    parts = digests.select("digest").mapInArrow(_build(bits), "chunk long, once binary, again binary")
    merged = parts.repartition(local_partitions(digests.sparkSession), "chunk").mapInArrow(
        _merge, "chunk long, again binary")
    out = np.zeros(bits // 8, np.uint8)
    step = CHUNK_BITS // 8
    for row in merged.collect():  # at most max_filter_bytes
        out[row.chunk * step:(row.chunk + 1) * step] = np.frombuffer(row.again, np.uint8)
    return out


def exact_groups(docs: DataFrame, bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (SHA-256 of the text's UTF-8
    bytes), keep_id, group_size, kept.

    Null text counts as empty; empty texts are equal to each other.  The largest
    doc_id of a group stays; null ids count as smallest, a group of null ids
    keeps them all, and rows that repeat the largest id are all kept.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    thin = stage(docs.select("doc_id", F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("digest")),
                 "exact_digests")
    again = spark.sparkContext.broadcast(repeated_filter(thin, thin.count(), bits_per_row, max_filter_bytes))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = again.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            maybe = has(bitmap, _slots(batch.column("digest"), len(bitmap) * 8)).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], ["doc_id", "digest", "maybe"])

    flagged = stage(thin.mapInArrow(flag, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                                          "digest binary, maybe boolean"), "exact_flagged")
    straight = flagged.filter(~F.col("maybe")).select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    maybe = flagged.filter("maybe").select("doc_id", "digest")
    groups = stage(maybe.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")),
                   "exact_groups")
    grouped = maybe.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size")
    return straight.unionByName(grouped).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
