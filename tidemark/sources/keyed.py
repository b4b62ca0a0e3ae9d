"""Keyed tables: a base in key ranges and folders of changed rows.

The base is written once in ranges of the key, each a folder of its own with its rows
sorted by key.  A batch of changes writes the new images of the rows that it touches and
nothing else; a version (``sources/versions.py``) names the base folders and, in order,
the change folders.  Reading takes the newest image of each changed key (a partial
aggregate over the changes alone) and the base rows of all other keys, an anti join whose
build side is the changed keys.  ``compact`` rewrites the ranges that have changes and
leaves the folders of the others where they are.

Keys are unique and of one orderable type; rows with a null key are kept, and cannot be
changed.  A batch is known by its id: applied again it changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.sources import versions
from tidemark.sources.versions import Version, VersionConflict

RANGES = 1024     # most key ranges of a table; a range may hold several files
PROBE = 1000      # distinct keys that are looked up as literals, pushed down to row groups
KEPT_BATCHES = 10_000  # batch ids remembered; an older batch must not be applied again
ATTEMPTS = 5


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    key: str

    # --- writing -------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, key: str, ranges: int | None = None) -> KeyedTable:
        """Store ``rows`` as the first version of the table at ``path``, in as many ranges as
        a shuffle has partitions (``RANGES`` at most) unless ``ranges`` says how many."""
        table = cls(spark, path, key)
        base = table._write_ranges(rows, ranges)
        versions.commit(spark, path, [r["folder"] for r in base], None, only_after=True, base=base, changes=[], batches=[],
                        schema=rows.schema.json())
        return table

    def clone(self, path: str) -> KeyedTable:
        """A table of its own that starts from this one's newest version; no row is copied."""
        body = self.version().body
        versions.commit(self.spark, path, body["folders"], None, only_after=True,
                        **{k: body[k] for k in ("base", "changes", "batches", "schema")})
        return KeyedTable(self.spark, path, self.key)

    def _write_ranges(self, rows: DataFrame, ranges: int | None = None) -> list[dict]:
        """Write ``rows`` in ranges of the key; each range with its folder and last key.
        There are as many sorted files as a shuffle has partitions, several to a range
        where that is more than the ranges."""
        folder = versions.attempt_folder(self.path)
        ranges = ranges or min(self._tasks(), RANGES)
        tasks = max(ranges, self._tasks())
        number = F.floor(F.spark_partition_id() * ranges / tasks).cast("int")
        placed = rows.repartitionByRange(tasks, self.key).withColumn("_range", number)
        (placed.sortWithinPartitions(self.key).write.option("compression", "snappy")
         .option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("_range").parquet(folder))
        stored = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(folder)
        ends = stored.groupBy("_range").agg(F.max(self.key).cast("string").alias("last")).orderBy("_range").collect()
        return [{"folder": f"{folder}/_range={r['_range']}", "last": r["last"]} for r in ends]

    def apply(self, batch_id: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Version:
        """Write the images that ``change`` makes of the rows named by ``keys`` (a frame with
        the key column) as one change folder.

        ``change`` gets those rows and returns rows of the table's columns, at most one per
        key; keys that the table does not hold are added.  A batch that is in already
        changes nothing.  Where another writer publishes first, the batch is made again
        from the rows that it left.
        """
        for _ in range(ATTEMPTS):
            version = self.version()
            if batch_id in version.body["batches"]:
                return version
            fields = self._schema(version).names
            rows = change(self.lookup(keys, version)).select(*fields, F.lit(version.number + 1).alias("_seq"))
            folder = versions.attempt_folder(self.path)
            rows.filter(F.col(self.key).isNotNull()).write.option("compression", "snappy").parquet(folder)
            body = version.body
            try:
                return versions.commit(self.spark, self.path, [*body["folders"], folder], version, only_after=True,
                                       base=body["base"], changes=[*body["changes"], folder], schema=body["schema"],
                                       batches=[*body["batches"], batch_id][-KEPT_BATCHES:])
            except VersionConflict:
                continue
        raise VersionConflict(f"{self.path}: {ATTEMPTS} attempts met other writers")

    def compact(self) -> Version:
        """Fold the changes into the base: only ranges that a changed key falls into are
        read and written."""
        version = self.version()
        body, schema = version.body, self._schema(version)
        if not body["changes"]:
            return version
        newest = self._newest(version)
        if not body["base"]:
            base = self._write_ranges(newest)
            return versions.commit(self.spark, self.path, [r["folder"] for r in base], version, only_after=True, base=base,
                                   changes=[], batches=body["batches"], schema=body["schema"])
        hit = sorted(r[0] for r in newest.select(self._range_of(version, F.col(self.key))).distinct().collect())  # at most the ranges
        old = self.spark.read.schema(schema).parquet(*[body["base"][i]["folder"] for i in hit])
        rows = self._merged(old, newest)
        folder = versions.attempt_folder(self.path)
        placed = rows.withColumn("_range", self._range_of(version, F.col(self.key)))
        files = len(hit) * -(-self._tasks() // len(body["base"]))
        (placed.repartitionByRange(files, "_range", self.key).sortWithinPartitions("_range", self.key).write.option("compression", "snappy")
         .option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("_range").parquet(folder))
        base = [dict(r) for r in body["base"]]
        ends = {r["_range"]: r["last"] for r in placed.groupBy("_range").agg(F.max(self.key).cast("string").alias("last")).collect()}
        for i in hit:
            base[i] = {"folder": f"{folder}/_range={i}", "last": ends[i] if i == len(base) - 1 else base[i]["last"]}
        return versions.commit(self.spark, self.path, [r["folder"] for r in base], version, only_after=True, base=base,
                               changes=[], batches=body["batches"], schema=body["schema"])

    # --- reading -------------------------------------------------------------

    def version(self) -> Version:
        found = versions.latest(self.spark, self.path)
        if found is None:
            raise FileNotFoundError(f"no version of a table at {self.path}")
        return found

    def read(self, version: Version | None = None, mark: str | None = None) -> DataFrame:
        """All rows as of a version (the newest by default).  ``mark`` names a boolean
        column that tells rows which a change folder holds from rows of the base."""
        version = version or self.version()
        body, schema = version.body, self._schema(version)
        base = self._parquet(schema, [r["folder"] for r in body["base"]])
        marked = (lambda df, on: df.withColumn(mark, F.lit(on))) if mark else (lambda df, on: df)
        if not body["changes"]:
            return marked(base, False)
        newest = self._newest(version)
        kept = base.join(newest.select(self.key), self.key, "left_anti").select(*schema.names)
        return marked(kept, False).unionByName(marked(newest, True))

    def lookup(self, keys: DataFrame, version: Version | None = None) -> DataFrame:
        """The rows of the table whose key is in ``keys``.  Up to ``PROBE`` keys are read as
        literals: only ranges that can hold them are opened, and row groups are skipped by
        their statistics.  More keys are a semi join with the table streamed."""
        version = version or self.version()
        body, schema = version.body, self._schema(version)
        wanted = keys.select(F.col(self.key)).filter(F.col(self.key).isNotNull()).distinct()
        some = [r[0] for r in wanted.limit(PROBE + 1).collect()]  # at most PROBE + 1 keys
        if len(some) <= PROBE:
            held = F.col(self.key).isin(some)
            ranges = self.spark.createDataFrame([(k,) for k in some], T.StructType([schema[self.key]])) if some else None
            hit = {r[0] for r in ranges.select(self._range_of(version, F.col(self.key))).collect()} if some else set()
            base = self._parquet(schema, [r["folder"] for i, r in enumerate(body["base"]) if i in hit]).filter(held)
            changed = self._newest(version).filter(held) if body["changes"] else None
        else:
            base = self._parquet(schema, [r["folder"] for r in body["base"]]).join(wanted, self.key, "left_semi")
            changed = self._newest(version).join(wanted, self.key, "left_semi") if body["changes"] else None
        return base.select(*schema.names) if changed is None else self._merged(base, changed)

    # --- parts ---------------------------------------------------------------

    def _tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _schema(self, version: Version) -> T.StructType:
        return T.StructType.fromJson(json.loads(version.body["schema"]))

    def _parquet(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _newest(self, version: Version) -> DataFrame:
        """The newest image of each changed key."""
        schema = self._schema(version)
        stored = T.StructType([*schema.fields, T.StructField("_seq", T.IntegerType())])
        rows = self.spark.read.schema(stored).parquet(*version.body["changes"])
        if len(version.body["changes"]) == 1:
            return rows.select(*schema.names)
        rest = [c for c in schema.names if c != self.key]
        newest = F.max_by(F.struct(*rest), "_seq").alias("_row")
        return rows.groupBy(self.key).agg(newest).select(
            *[F.col(c) if c == self.key else F.col(f"_row.`{c}`").alias(c) for c in schema.names])

    def _merged(self, base: DataFrame, newest: DataFrame) -> DataFrame:
        return base.join(newest.select(self.key), self.key, "left_anti").select(*newest.columns).unionByName(newest)

    def _range_of(self, version: Version, key: Column) -> Column:
        """The number of the range that a key falls into: ranges that end before it."""
        schema = self._schema(version)
        ends = [r["last"] for r in version.body["base"][:-1]]
        if not ends:
            return F.lit(0).alias("_range")
        before = F.array(*[F.lit(e).cast(schema[self.key].dataType) for e in ends])
        ended = F.size(F.filter(before, lambda e: e.isNull() | (e < key)))
        return F.when(key.isNull(), F.lit(0)).otherwise(ended).alias("_range")

