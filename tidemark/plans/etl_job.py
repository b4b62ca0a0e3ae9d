"""The nightly sales ETL as one Spark job.

raw CSV -> classify -> (valid -> dedupe -> curated, partitioned by year/month)
                     -> (invalid -> quarantine)
The three run counts come from ``observe`` during the writes, not from extra
count actions.  Each write scans the source for the columns it needs; a caller
with a small or costly source can have the parsed rows kept instead.  A run is a
full recompute: both outputs are written to folders of their own and then published
as new versions, so a run that dies leaves the tables of the last one, re-running over
the same raw prefix changes nothing (T2) and no row of an earlier run is left.
"""

from __future__ import annotations

import datetime as _dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tidemark import vocab
from tidemark.operators import etl
from tidemark.sources import files, versions


def run_etl(spark: SparkSession, raw: DataFrame, curated_path: str, quarantine_path: str,
            run_id: str, metrics_path: str | None = None, environment: str = "prod",
            run_at: _dt.datetime | None = None,
            storage_level: StorageLevel | None = None) -> dict[str, int]:
    """Run the ETL as ``run_id``, which names the run's metric rows and is kept in the
    tables' versions; the same run repeated replaces its metric rows and publishes the
    same tables again.  ``storage_level`` keeps the parsed rows between the
    two writes, which at scale is a second copy of the source on executor disks."""
    read_obs = Observation("etl_read")
    typed = etl.classify(raw)
    if storage_level is not None:
        typed = typed.persist(storage_level)
    try:
        cur_obs = Observation("etl_curated")
        curated = etl.project_curated(etl.dedupe_latest(etl.filter_valid_sales(typed)))
        curated = curated.observe(cur_obs, F.count(F.lit(1)).alias("RowsCurated"))
        curated_folder = files.write_attempt(curated, curated_path, ("year", "month"))
        # counts come from the write of all rejects, whose scan sees every raw row
        quarantined = etl.project_drop(etl.filter_quarantine(typed.observe(
            read_obs, F.count(F.lit(1)).alias("RowsRead"), F.count_if(~F.col("is_valid")).alias("RowsQuarantined"))))
        quarantine_folder = files.write_attempt(quarantined, quarantine_path)
        # both are written: publishing them takes two small files
        versions.commit(spark, curated_path, [curated_folder], run_id=run_id)
        versions.commit(spark, quarantine_path, [quarantine_folder], run_id=run_id)
        counts = {**read_obs.get, **cur_obs.get}
    finally:
        if storage_level is not None:
            typed.unpersist()
    counts = {k: int(counts[k]) for k in vocab.ETL_METRIC_NAMES}
    if metrics_path:
        at = run_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        rows = [(name, float(counts[name]), "Count", environment, at) for name in vocab.ETL_METRIC_NAMES]
        m = spark.createDataFrame(rows, "metric_name string, value double, unit string, environment string, ts timestamp_ntz")
        files.emit_metrics(m, metrics_path, run_id)
    return counts
