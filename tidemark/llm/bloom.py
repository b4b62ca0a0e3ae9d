"""A Bloom filter over hashes, of bounded size, used as a filter before a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import local_partitions

CHUNK_BITS = 1 << 13  # a filter travels in pieces of 1 KB


def filter_bits(rows: int, bits_per_row: int, max_bytes: int) -> int:
    bits = CHUNK_BITS
    while bits < bits_per_row * rows and bits < 8 * max_bytes:
        bits *= 2
    return bits


def mark(bitmap: np.ndarray, slots: np.ndarray) -> None:
    """Set sorted unique ``slots`` in a packed bitmap."""
    if not len(slots):
        return
    byte = slots >> 3
    first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
    bitmap[byte[first]] |= np.bitwise_or.reduceat((1 << (slots & 7)).astype(np.uint8), first)


def has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def hash_slots(hashes: np.ndarray, bits: int, slots: int = 4) -> np.ndarray:
    """Slots of 64-bit hashes, shape (rows, slots), by double hashing."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(slots, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) % np.uint64(bits)).astype(np.int64)


def build(hashes: DataFrame, rows: int, bits_per_row: int = 16, max_bytes: int = 64 << 20) -> np.ndarray:
    """The packed bitmap of all values of the one long column of ``hashes``.  Fuller
    than planned (beyond ``max_bytes``) it lets more through, never less."""
    bits = filter_bits(rows, bits_per_row, max_bytes)
    step = CHUNK_BITS // 8

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                mark(bitmap, np.unique(hash_slots(values, bits)))
        used = np.flatnonzero(bitmap.reshape(-1, step).any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([bitmap[i * step:(i + 1) * step].tobytes() for i in used], pa.binary())],
            ["chunk", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(piece, np.uint8)
                held[chunk] = held[chunk] | own if chunk in held else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
            ["chunk", "bits"])

    schema = "chunk long, bits binary"
    merged = hashes.mapInArrow(parts, schema).repartition(local_partitions(hashes.sparkSession), "chunk").mapInArrow(
        merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # at most max_bytes
        out[row.chunk * step:(row.chunk + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return out
