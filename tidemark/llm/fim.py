"""Fill-in-the-middle: texts cut at two unit borders and put in another order.

The borders of a text's units are kept as a compressed set in the manner of Roaring
bitmaps: offsets are split into a high part, which names a container, and 16 low bits
held in the smallest of three forms (sorted array, bitmap, runs).  Cumulative
cardinalities over the containers turn "the border after k units" into a binary
search for the container and a select inside it, so both cuts cost no walk over the
text, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_blocks, text_bytes, text_or_empty

SEED = 7
PLAIN_PERCENT = 0  # share of texts left as they are
SPM_PERCENT = 50  # share of the others that start with the suffix
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

BLOCK = 4 << 20  # bytes of text looked at together
CONTAINER = 1 << 16


class ArrayContainer:
    """Sorted 16-bit values, two bytes each."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit per possible value, with the number of bits before each 64-bit word."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(CONTAINER, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.words[at:at + 1].view(np.uint8), bitorder="little"))
        return at * 64 + int(inside[k - self.before[at]])


class RunContainer:
    """Runs of consecutive values: first values, and the number of values before each."""

    def __init__(self, low: np.ndarray, first: np.ndarray) -> None:
        self.starts = low[first].astype(np.uint16)
        self.before = first

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form for sorted distinct values below 65536."""
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1] + 1])
    sizes = {"run": 4 * len(first), "array": 2 * len(low), "bitmap": CONTAINER // 8}
    form = min(sizes, key=sizes.get)
    if form == "run":
        return RunContainer(low, first)
    return ArrayContainer(low) if form == "array" else BitmapContainer(low)


class BoundarySet:
    """A set of offsets, given sorted and distinct; ``select(k)`` is the k-th smallest
    (from 0) and ``cut(k)`` the offset after k units (0 for none)."""

    def __init__(self, offsets: np.ndarray) -> None:
        high = offsets >> 16
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(offsets) else np.zeros(0, np.int64)
        self.keys = high[starts]
        self.upto = np.r_[starts[1:], len(offsets)].astype(np.int64) if len(offsets) else starts
        self.containers = [container(offsets[a:b] & 0xFFFF) for a, b in zip(starts.tolist(), self.upto.tolist())]

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[at - 1]) if at else 0
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - before)

    def cut(self, units: int) -> int:
        return self.select(units - 1) if units else 0


def line_borders(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the code-point offsets at which its lines end (each after its line
    feed, the last one at the end of the text)."""
    heads = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with this byte
    breaks = np.flatnonzero(data == 0x0A)
    at = np.searchsorted(breaks, offsets)
    for i, (lo, hi) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        if lo == hi:
            yield np.zeros(0, np.int64)
            continue
        base = int(heads[lo - 1]) if lo else 0
        ends = heads[breaks[at[i]:at[i + 1]]] - base
        yield ends if data[hi - 1] == 0x0A else np.r_[ends, heads[hi - 1] - base]


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, h1, h2 ... -> the same columns with n and both cut offsets."""
    for block in byte_blocks(batches, "text", BLOCK):
        data, offsets = text_bytes(block.column("text"))
        drawn = zip(block.column("h1").to_pylist(), block.column("h2").to_pylist())
        found = []
        for borders, (a, b) in zip(line_borders(data, offsets), drawn):
            units = BoundarySet(borders)
            n = len(units)
            a, b = a % (n + 1), b % (n + 1)
            found.append((n, units.cut(min(a, b)), units.cut(max(a, b))))
        added = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
        out = pa.Table.from_arrays([*block.columns, *added], [*block.column_names, "n", "cut1", "cut2"])
        yield from out.combine_chunks().to_batches()


def _drawn(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT,
                   spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (lines), form, prefix_chars, middle_chars
    (code points) and output, the text in its new order.

    The prefix ends after the smaller of two drawn numbers of lines, the middle after
    the larger.  Form ``psm`` is prefix, suffix, middle, each after its mark; ``spm``
    starts with the suffix; ``plain`` is the text as it is, with null lengths: empty
    texts, texts that hold one of the marks, and ``plain_percent`` of the rest.
    Null text counts as empty; a null doc_id is drawn for as empty text, repeated rows
    get equal results, and an empty table gives an empty result.  Texts of any length
    are cut whole; blocks are made by bytes.  Other columns are ignored.
    """
    h1, h2, h3, h4 = _drawn(seed, F.col("doc_id"))
    given = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id", "text", h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, h1 long, h2 long, h3 long, h4 long, "
              "n long, cut1 long, cut2 long")
    cut = given.mapInArrow(_cuts, schema)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    cut = cut.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    length = F.length("text")
    prefix = F.substring("text", F.lit(1), F.col("cut1").cast("int"))
    middle = F.substring("text", (F.col("cut1") + 1).cast("int"), (F.col("cut2") - F.col("cut1")).cast("int"))
    suffix = F.substring("text", (F.col("cut2") + 1).cast("int"), length)
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    cut_only = F.col("form") != "plain"
    return cut.select("doc_id", "n", "form", F.when(cut_only, F.col("cut1")).alias("prefix_chars"),
                      F.when(cut_only, F.col("cut2") - F.col("cut1")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output, from the output and its form alone: the marks occur in no
    part and no mark starts inside another, so each is found at its first place."""
    def between(after: str, before: str | None) -> Column:
        start = F.instr(output, after) + len(after)
        stop = F.instr(output, before) if before else F.length(output) + 1
        return F.substring(output, start, stop - start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
