"""Helpers shared by the operators: staged tables, Arrow text access, hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"  # a word: no ASCII white space


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage; the files survive the loss of executors.  Columns keep
    their order and types.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in range(len(taken) + 1) if (n := "_" * i + name).lower() not in taken) for name in names]


def text_or_empty(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def scalar(df: DataFrame, default=None):
    """The first value of a one-row aggregate, or ``default`` when absent or null."""
    row = df.first()
    return default if row is None or row[0] is None else row[0]


def text_bytes(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_string())
    _, offs, data = arr.buffers()
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Arrow batches regrouped into tables whose text column holds about ``limit``
    bytes (one row at least), so that memory does not depend on text lengths."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and size + total + n > limit:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start, total = [], 0, i, 0
            total += n
        held.append(batch.slice(start))
        size += total
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value, drawn from ``seed``."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def local_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODES = byte_codes(1)
_BASE = np.uint64(0xD1342543DE82EF95)


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts, and how many words come
    before each text (n + 1 numbers).  A word never crosses a text's border."""
    inside = ~space[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        begin[edge] = inside[edge]
        end[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(first, lens)
    powers = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64))
    codes = _CODES[data[at + np.repeat(starts, lens)]]
    codes *= powers[at]
    return mix64(np.add.reduceat(codes, first) ^ lens.astype(np.uint64))
