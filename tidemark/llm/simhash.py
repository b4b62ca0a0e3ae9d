"""Near duplicates by SimHash fingerprints and the pigeonhole principle.

Two fingerprints that differ in at most ``DISTANCE`` bits agree on all but
``DISTANCE`` of the blocks that the bits are cut into; joined on every choice of that
many agreeing blocks, they meet at least once.  What meets is verified by its Hamming
distance.  More blocks make longer keys: their number follows the number of
fingerprints, so that buckets stay small on evenly spread data, and changes no result.

Rows of equal fingerprint are folded before anything is compared.  A bucket of up to
``GROUP`` fingerprints is compared in its task and passes on a spanning forest.  In a
larger one all pairs would be too many: each member goes to every value that is at
most DISTANCE / 2 flips away, over the bits that vary in its crowded buckets.  Two
members within the distance share such a middle value, at most some thousand members
can meet at one, and all that meet are within the distance of each other; so neighbours
in order at a middle are linked, and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_blocks, local_partitions, stage, text_bytes, word_spans
from tidemark.llm.components import components

WORDS = 4
SEED = 42
DISTANCE = 4
BITS = 64
GROUP = 4096  # fingerprints of a bucket compared in one task
BUCKET = 256  # aimed at mean fingerprints in a bucket
BLOCK = 1 << 20  # bytes of text hashed together

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of the texts and the number of shingles before each text."""
    starts, ends, bounds = word_spans(data, offsets)
    lens = ends - starts
    # the words of all texts with one space after each
    begin = np.cumsum(lens + 1) - (lens + 1)
    joined = np.full(int((lens + 1).sum()), 0x20, np.uint8)
    if len(lens):
        first = np.cumsum(lens) - lens
        inner = np.arange(int(lens.sum())) - np.repeat(first, lens)
        joined[inner + np.repeat(begin, lens)] = _FOLD[data[inner + np.repeat(starts, lens)]]
    words = np.diff(bounds)
    counts = np.where(words == 0, 0, np.maximum(words - WORDS + 1, 1))
    before = np.r_[0, np.cumsum(counts)]
    head = np.arange(int(before[-1])) - np.repeat(before[:-1], counts) + np.repeat(bounds[:-1], counts)
    tail = np.minimum(head + WORDS, np.repeat(bounds[1:], counts)) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(raw[a:b], SEED) for a, b in zip(begin[head].tolist(), (begin[tail] + lens[tail]).tolist())]
    return np.array(hashes, np.uint64), before


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each text; zero for texts without words."""
    hashes, before = shingle_hashes(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(np.diff(before))
    if not len(full):
        return out
    counts = np.diff(before)[full]
    for bit in range(BITS):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), before[:-1][full])
        out[full] |= (2 * ones > counts).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in byte_blocks(batches, "text", BLOCK):
        fp = fingerprints(*text_bytes(block.column("text")))
        out = pa.Table.from_arrays([block.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
        yield from out.combine_chunks().to_batches()


def block_count(rows: int) -> int:
    """The fewest blocks whose keys spread ``rows`` fingerprints to ``BUCKET`` a bucket."""
    blocks = DISTANCE + 1
    while blocks < 2 * DISTANCE and rows > BUCKET << (BITS * (blocks - DISTANCE) // blocks):
        blocks += 1
    return blocks


def block_keys(fp: np.ndarray, blocks: int) -> np.ndarray:
    """One key per choice of ``blocks - DISTANCE`` blocks, shape (rows, choices): the
    choice's number above the chosen blocks' bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for choice, chosen in enumerate(combinations(range(blocks), blocks - DISTANCE)):
        key = np.full(len(fp), choice, np.uint64)
        for b in chosen:
            width = np.uint64(edges[b + 1] - edges[b])
            key = (key << width) | ((fp >> np.uint64(edges[b])) & ((np.uint64(1) << width) - np.uint64(1)))
        keys.append(key)
    return np.stack(keys, axis=1)


def _keyed(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = block_keys(fp, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)),
                                              pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))], ["key", "fp"])
    return run


def forest(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the distance inside each key; rows are ordered by
    key.  Row i is held against row i + 1, then i + 2, while the key lasts."""
    parent = list(range(len(fp)))
    root = np.arange(len(fp))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    rows, lag = np.arange(len(fp) - 1), 0
    while len(rows):
        lag += 1
        rows = rows[rows + lag < len(fp)]
        rows = rows[key[rows] == key[rows + lag]]
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + lag]) <= DISTANCE]
        near = near[root[near] != root[near + lag]]
        for i in near.tolist():
            a, b = top(i), top(i + lag)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, i + lag))
        if len(near):
            root = np.array(parent)
            while (root[root] != root).any():
                root = root[root]
    at = np.array(links, np.int64).reshape(-1, 2)
    return fp[at[:, 0]], fp[at[:, 1]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) ordered by key -> links; a key's rows are held until they are all there."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def linked(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = forest(k, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["x", "y"])

    for batch in batches:
        key = np.r_[key, batch.column(0).to_numpy(zero_copy_only=False)]
        fp = np.r_[fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if not len(key):
            continue
        whole = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])  # the last key may go on
        if whole:
            yield linked(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
    if len(key):
        yield linked(key, fp)


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, mask) -> (middle, fp): every value at most DISTANCE / 2 flips of the
    mask's bits away."""
    mask, flips = None, np.zeros(0, np.uint64)
    for batch in batches:
        for fp, own in zip(*(c.to_numpy(zero_copy_only=False).view(np.uint64).tolist() for c in batch.columns[:2])):
            if own != mask:
                mask, bits = own, [1 << i for i in range(BITS) if own >> i & 1]
                flips = np.array([sum(c) for n in range(DISTANCE // 2 + 1) for c in combinations(bits, n)], np.uint64)
            middle = flips ^ np.uint64(fp)
            yield pa.RecordBatch.from_arrays([pa.array(middle.view(np.int64)),
                                              pa.array(np.full(len(flips), fp, np.uint64).view(np.int64))], ["middle", "fp"])


def _bytes(col: str) -> Column:
    return F.unhex(F.lpad(F.hex(col), 16, "0"))


def links(prints: DataFrame, group: int = GROUP, blocks: int | None = None) -> DataFrame:
    """Links (x, y) between the distinct values of ``prints`` (one long column ``fp``):
    all of them are within the distance, and they connect whatever is."""
    spark = prints.sparkSession
    parts = local_partitions(spark)
    keyed = stage(prints.mapInArrow(_keyed(blocks or block_count(prints.count())), "key long, fp long"), "simhash_keys")
    crowded = stage(keyed.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_or(fp) & ~bit_and(fp)").alias("mask"))
                    .filter(F.col("n") > group).select("key", "mask"), "simhash_crowded")
    if crowded.isEmpty():
        return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compared, "x long, y long")
    small = keyed.join(crowded, "key", "left_anti").repartition(parts, "key").sortWithinPartitions("key")
    members = keyed.join(crowded, "key").groupBy("fp").agg(F.expr("bit_or(mask)").alias("mask"))
    middles = members.repartition(4 * parts).sortWithinPartitions("mask").mapInArrow(_middles, "middle long, fp long")
    before = F.lag("fp").over(Window.partitionBy("middle").orderBy("fp"))
    met = middles.select(before.alias("x"), F.col("fp").alias("y")).filter(
        F.col("x").isNotNull() & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= DISTANCE))
    return small.mapInArrow(_compared, "x long, y long").union(met)


def near_groups(docs: DataFrame, group: int = GROUP, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits) and
    component_id, the smallest doc_id that links reach.

    Words are runs without ASCII white space, A to Z lower-cased; shingles are four
    words, fewer words are one shingle.  Null, empty and white-space texts have
    fingerprint zero and are linked like any other.  A bit is one if it is set in over
    half the shingles' hashes; ties give zero.  Rows that repeat an id are rows of
    their own; null ids are never a component's smallest unless it has no other, then
    component_id is null.  Texts of any length are hashed whole, block by block; an
    empty table gives an empty result.  Other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    prints = stage(docs.select("doc_id", "text").mapInArrow(_fingerprinted, f"doc_id {id_type}, fp long"), "simhash_prints")
    groups = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash_groups")
    found = links(groups.select("fp"), group, blocks)
    rooted = components(found.select(_bytes("x").alias("a"), _bytes("y").alias("b")))
    placed = groups.withColumn("vertex", _bytes("fp")).join(rooted, "vertex", "left").select(
        "fp", "least", F.coalesce("root", "vertex").alias("root"))
    placed = stage(placed, "simhash_placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    table = stage(placed.join(named, "root").select("fp", "component_id"), "simhash_components")
    return prints.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
