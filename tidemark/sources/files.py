"""File sources and sinks: header CSV with a declared schema, Parquet, JSON lines."""

from __future__ import annotations

import datetime as _dt
import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.sources import versions

RAW_SALES_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType(), nullable=False),
    T.StructField("product_id", T.StringType(), nullable=False),
    T.StructField("order_date", T.TimestampType(), nullable=False),
    T.StructField("quantity", T.IntegerType(), nullable=True),
    T.StructField("unit_price", T.StringType(), nullable=True),
    T.StructField("warehouse_id", T.StringType(), nullable=True),
    T.StructField("channel", T.StringType(), nullable=True),
    T.StructField("ingested_at", T.TimestampType(), nullable=True),
])


INDEX_ROW_GROUP = 8 << 20  # bytes of a row group in an index: what a probe reads at least


def as_nullable(schema: T.StructType) -> T.StructType:
    """The same schema with every field nullable (what a CSV scan returns)."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def scan_csv_schema(spark: SparkSession, path: str, schema: T.StructType = RAW_SALES_SCHEMA,
                    keep_corrupt: bool = False) -> DataFrame:
    """Header CSV under ``path`` with a declared schema; malformed fields -> null.

    With ``keep_corrupt`` the original text of a malformed line is kept in
    ``_corrupt_record`` (the raw quantity / date text is otherwise lost).
    """
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    if keep_corrupt:
        schema = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def sink_parquet_partitioned(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ("year", "month")) -> None:
    """Overwrite only the partitions present in ``df`` (idempotent re-runs).

    The rebalance hint lets AQE split a hot partition value over several
    tasks/files instead of one task per month.
    """
    (df.hint("rebalance", *partition_cols)
       .write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .option("compression", "snappy")
       .partitionBy(*partition_cols)
       .parquet(path))


def publish_snapshot(df: DataFrame, path: str, partition_cols: tuple[str, ...] = (), **info) -> versions.Version:
    """Replace a table by a full recompute: the rows go to a folder that no other run
    uses, then a new version names it (``sources/versions.py``).

    Nothing of an earlier run is left in the table (a row that changed its partition
    does not stay in the old one), readers never see half a run, and a run that dies
    before its version leaves the table as it was.
    """
    return versions.commit(df.sparkSession, path, [write_attempt(df, path, partition_cols)], **info)


def write_attempt(df: DataFrame, path: str, partition_cols: tuple[str, ...] = (), dealt: bool = False) -> str:
    """Write ``df`` to a new folder of table ``path``; it is no part of the table until
    ``versions.commit`` names it.  With ``dealt`` its rows lie by partition already."""
    folder = versions.attempt_folder(path)
    df = df.hint("rebalance", *partition_cols) if partition_cols and not dealt else df
    writer = df.write.option("compression", "snappy")
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(folder)
    return folder


def publish_index(df: DataFrame, path: str, key: str, order: list[Column]) -> versions.Version:
    """Publish ``df`` as an index on ``key``: range-partitioned and sorted by (key, order),
    so that the rows of a key lie together in one or few files, and row groups are skipped
    by their statistics and by Bloom filters on the key.  A hot key fills as many ranges
    as it needs, as the order column splits it."""
    folder = versions.attempt_folder(path)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(tasks, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
       .write.option("compression", "snappy").option("parquet.block.size", INDEX_ROW_GROUP)
       .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(folder))
    return versions.commit(df.sparkSession, path, [folder])


def read_snapshot(spark: SparkSession, path: str, version: versions.Version | None = None) -> DataFrame:
    """The rows of a version, by default of the newest."""
    version = version or versions.latest(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version of a table at {path}")
    return spark.read.parquet(*version.folders)


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def sink_run(df: DataFrame, path: str, run_id: str) -> None:
    """Add a run's rows to a growing table: the run's own folder is overwritten, so a
    run that is repeated leaves each row once."""
    sink_parquet(df, f"{path}/run_id={run_id}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs of ``sink_run``."""
    return spark.read.parquet(path).drop("run_id")


def emit_metrics(df: DataFrame, path: str, run_id: str) -> bool:
    """``sink_run`` for metric rows; a failure is logged and never fails the caller."""
    try:
        sink_run(df, path, run_id)
        return True
    except Exception as exc:  # noqa: BLE001 - observability is best effort
        logging.getLogger(__name__).warning("metric emission to %s failed: %s", path, exc)
        return False


def partition_listing(spark: SparkSession, path: str) -> DataFrame:
    """The partitions of a hive-partitioned folder: partition (``year=2026/month=1``),
    n_files, n_bytes, newest (modification time).  The listing is a scan of file names,
    which Spark spreads over tasks where there are many; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_extract("path", r"((?:/[^/=]+=[^/]+)+)/[^/]+$", 1).alias("partition"), "length", "modificationTime")
    return found.filter(F.col("partition") != "").groupBy(F.substring("partition", 2, 10_000).alias("partition")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.max("modificationTime").alias("newest"))


def discover_partitions(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """Compare the partitions of ``path`` with the last listing, kept as versions of the
    table ``manifest``, and publish the new one: (partition, change) with change added,
    changed or deleted.  Deletions are reported once and change nothing else."""
    known = versions.latest(spark, manifest)
    now = versions.commit(spark, manifest, [write_attempt(partition_listing(spark, path).coalesce(1), manifest)])
    new = read_snapshot(spark, manifest, now)
    old = read_snapshot(spark, manifest, known) if known else new.limit(0)
    state = F.struct("n_files", "n_bytes", "newest")
    both = new.select("partition", state.alias("new")).join(old.select("partition", state.alias("old")), "partition", "full")
    change = (F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted")
              .when(F.col("new") != F.col("old"), "changed"))
    return both.select("partition", change.alias("change")).filter(F.col("change").isNotNull())


def catalog_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Register a partitioned Parquet folder as an external catalog table, or bring
    the table up to date (the nightly discovery step): new columns and partitions are
    added.  Partitions whose folders are gone stay in the catalog and hold no rows;
    ``discover_partitions`` reports them."""
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source="parquet")
    else:
        stored = read_partitioned(spark, path, merge_schema=True).schema
        partitions = {c.name for c in spark.catalog.listColumns(name) if c.isPartition}
        known = {c.name for c in spark.catalog.listColumns(name)}
        added = [f for f in stored.fields if f.name not in known | partitions]
        if added:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")
    spark.sql(f"MSCK REPAIR TABLE {name} ADD PARTITIONS")
    spark.catalog.refreshTable(name)
    return spark.read.option("ignoreMissingFiles", "true").table(name)


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


NEVER = "never"  # the expiry folder of rows that do not expire


def sink_expiring(df: DataFrame, path: str, run_id: str, ttl: str = "ttl") -> None:
    """Add a run's rows to a table laid out by the day on which they expire (``ttl``,
    epoch seconds).  A run that is repeated replaces its own folders of each day."""
    day = F.coalesce(F.date_format(F.timestamp_seconds(ttl), "yyyy-MM-dd"), F.lit(NEVER))
    (df.withColumns({"expires_on": day, "run_id": F.lit(run_id)}).hint("rebalance", "expires_on")
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
       .partitionBy("expires_on", "run_id").parquet(path))


def read_unexpired(spark: SparkSession, path: str, as_of_epoch: int, ttl: str = "ttl") -> DataFrame:
    """The rows of ``sink_expiring`` that have not expired: folders of past days are
    pruned, the rows of the day itself are filtered."""
    day = F.date_format(F.timestamp_seconds(F.lit(as_of_epoch)), "yyyy-MM-dd")
    stored = spark.read.option("ignoreMissingFiles", "true").schema(_expiring_schema(spark, path)).parquet(path)
    return stored.filter((F.col("expires_on") >= day) & (F.col(ttl).isNull() | (F.col(ttl) > as_of_epoch))).drop(
        "expires_on", "run_id")


def _expiring_schema(spark: SparkSession, path: str) -> T.StructType:
    """The table's columns with the folder columns as text (``never`` sorts after all days)."""
    found = spark.read.parquet(path).schema
    text = {"expires_on": T.StringType(), "run_id": T.StringType()}
    return T.StructType([T.StructField(f.name, text.get(f.name, f.dataType)) for f in found.fields])


def drop_expired(spark: SparkSession, path: str, as_of_epoch: int) -> list[str]:
    """Remove the folders of days that lie wholly before the time; no other file is
    touched.  Returns the days removed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    today = _dt.datetime.fromtimestamp(as_of_epoch, _dt.timezone.utc).strftime("%Y-%m-%d")
    days = {s.getPath().getName().partition("=")[2]: s.getPath() for s in fs.listStatus(root)
            if s.getPath().getName().startswith("expires_on=")}
    gone = sorted(d for d in days if d != NEVER and d < today)
    delete_folders(spark, [days[d].toString() for d in gone])
    return gone


def sink_json_lines(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_cols:
        w = df.hint("rebalance", *partition_cols).write.mode("overwrite")
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols)
    w.json(path)


def sink_text(df: DataFrame, path: str) -> None:
    """One text line per row (``df`` must have a single string column)."""
    df.write.mode("overwrite").text(path)


def read_partitioned(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """Read a hive-partitioned folder.  ``merge_schema`` also finds columns that only
    some files have, at the price of reading every file's footer."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
