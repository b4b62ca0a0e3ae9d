"""Sharding by fixed virtual slots.

Every record hashes into one of ``slots`` virtual slots, for good.  Bytes are
aggregated per slot, and a versioned map says which shard holds which slot.
Rebalancing edits the map (whole slots move) and never rehashes a record.  The
map has ``slots`` rows whatever the data, so it may be collected and broadcast.

Maps are stored as versions of a table (``stored_map``): a later run loads the newest
one and keeps to it; for another number of shards it edits that map and publishes the
edited one beside it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.session import scratch_path
from tidemark.sources import versions

SLOTS = 8192
RECORD_BYTES = 16  # counted for each record besides its text


@dataclass(frozen=True)
class SlotMap:
    """Version and shard of each virtual slot."""

    version: int
    shards: int
    owner: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, i, s) for i, s in enumerate(self.owner)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``docs`` with size, text_crc32 and virtual_slot.  The slot is a hash of
    doc_id; a record without one is placed by its text's checksum."""
    text = F.col("text").cast("binary")
    crc = F.crc32(F.coalesce(text, F.lit(b"")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc:"), crc.cast("string")))
    return docs.withColumns({
        "size": F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + RECORD_BYTES,
        "text_crc32": crc,
        "virtual_slot": F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"),
    })


def slot_bytes(placed: DataFrame, slots: int = SLOTS) -> list[int]:
    out = [0] * slots
    for row in placed.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect():  # at most ``slots`` rows
        out[row.virtual_slot] = row.b
    return out


def balanced_map(weights: list[int], shards: int) -> SlotMap:
    """Version 1: slots by falling weight, each to the lightest shard so far."""
    heap = [(0, 0, s) for s in range(shards)]
    owner = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        load, n, s = heapq.heappop(heap)
        owner[i] = s
        heapq.heappush(heap, (load + weights[i], n + 1, s))
    return SlotMap(1, shards, tuple(owner))


def rebalance(old: SlotMap, weights: list[int], shards: int) -> SlotMap:
    """The next version for ``shards`` shards: moves few slots.

    Slots of shards that go away are dealt to the lightest; then the heaviest
    shard gives its best-fitting slot to the lightest while that narrows the gap.
    When shards are added, only these take slots.
    """
    takers = range(old.shards, shards) or range(shards)
    owner = list(old.owner)
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    orphans = []
    for i, s in enumerate(owner):
        if s < shards:
            load[s] += weights[i]
            held[s].add(i)
        else:
            orphans.append(i)

    def move(i: int, to: int) -> None:
        owner[i] = to
        load[to] += weights[i]
        held[to].add(i)

    for i in sorted(orphans, key=lambda i: (-weights[i], i)):
        move(i, min(range(shards), key=lambda s: (load[s], len(held[s]), s)))
    for _ in range(len(owner)):
        high, low = max(range(shards), key=load.__getitem__), min(takers, key=load.__getitem__)
        gap = load[high] - load[low]
        fits = [i for i in held[high] if 0 < weights[i] < gap]
        if not fits:
            break
        best = min(fits, key=lambda i: (abs(gap - 2 * weights[i]), i))
        load[high] -= weights[best]
        held[high].discard(best)
        move(best, low)
    return SlotMap(old.version + 1, shards, tuple(owner))


def publish_map(spark: SparkSession, path: str, slot_map: SlotMap) -> None:
    """Store ``slot_map`` as the newest version of the maps at ``path``."""
    folder = versions.attempt_folder(path)
    slot_map.frame(spark).coalesce(1).write.parquet(folder)
    versions.commit(spark, path, [folder], map_version=slot_map.version, shards=slot_map.shards)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """The newest map stored at ``path``, or the one of that version; None if there is none."""
    for held in versions.history(spark, path):
        if version in (None, held.body["map_version"]):
            rows = spark.read.parquet(*held.folders).orderBy("virtual_slot").collect()  # one a slot
            return SlotMap(held.body["map_version"], held.body["shards"], tuple(r["shard"] for r in rows))
    return None


def stored_map(spark: SparkSession, path: str, weights: list[int], shards: int) -> SlotMap:
    """The map to place records by: the stored one where it is for ``shards`` shards;
    edited from it (``rebalance``) for another number; made from the bytes per slot
    (``weights``) where none is stored.  A map that is made or edited is published."""
    held = load_map(spark, path)
    if held is not None and (held.shards, len(held.owner)) == (shards, len(weights)):
        return held
    if held is not None and len(held.owner) != len(weights):
        raise ValueError(f"the maps at {path} have {len(held.owner)} slots, not {len(weights)}")
    made = balanced_map(weights, shards) if held is None else rebalance(held, weights, shards)
    publish_map(spark, path, made)
    return made


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, maps: str | None = None) -> tuple[DataFrame, SlotMap]:
    """``docs`` with size, text_crc32, virtual_slot and shard, and the map used, which is
    kept at ``maps`` (by default in a scratch folder of the run).

    Sizes of shards come near equal; a record is never split.  Null text has
    size RECORD_BYTES.  Repeated records share a slot.  Columns of ``docs`` with
    the added names are replaced.
    """
    spark = docs.sparkSession
    placed = with_slots(docs.drop("size", "text_crc32", "virtual_slot", "shard"), slots)
    weights = slot_bytes(placed.select("virtual_slot", "size"), slots)
    slot_map = stored_map(spark, maps or scratch_path(spark, "slot_maps"), weights, shards)
    return place(placed, slot_map), slot_map


def place(placed: DataFrame, slot_map: SlotMap) -> DataFrame:
    table = slot_map.frame(placed.sparkSession).select("virtual_slot", "shard")  # a row per slot
    return placed.join(F.broadcast(table), "virtual_slot")


def shard_positions(docs: DataFrame, shards: int, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot and
    virtual_slot; ``slot`` numbers the records of a shard from 0 without gaps.  The map
    is kept at ``maps`` (by default in a scratch folder of the run).  Null texts and ids
    are placed as ``with_slots`` says; repeated rows have numbers of their own; an empty
    table gives an empty result; other columns are ignored.

    Records are numbered inside their virtual slot, then moved up by the records
    in the slots before it in the shard: no task sees a whole shard.
    """
    thin = stage(with_slots(docs.select("doc_id", "text"), slots).drop("text"), "shard_rows")
    spark = docs.sparkSession
    slot_map = stored_map(spark, maps or scratch_path(spark, "slot_maps"), slot_bytes(thin, slots), shards)
    owner = slot_map.frame(spark)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (thin.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(F.broadcast(owner), "virtual_slot")
              .select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    starts = stage(starts, "shard_starts")  # at most SLOTS rows
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (thin.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(starts), "virtual_slot")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"),
                    "virtual_slot"))
