"""A key holding a third of all rows: results stay exact and whole."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import etl
from tidemark.operators import records as R
from tidemark.operators import updates as U
from tidemark.sources import files

T0 = dt.datetime(2026, 1, 1)


def test_hot_dedupe_key_keeps_exact_latest(spark):
    n = 9000
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("o"), F.col("id").cast("string"))).alias("order_id"),
        F.lit("p1").alias("product_id"),
        F.lit(T0).cast("timestamp").alias("order_date"),
        (F.col("id") % 7 + 1).cast("int").alias("quantity"),
        F.format_string("%d.00", F.col("id") % 50 + 1).alias("unit_price"),
        F.lit("w").alias("warehouse_id"),
        F.lit("web").alias("channel"),
        F.timestamp_add("SECOND", F.col("id"), F.lit(T0).cast("timestamp")).alias("ingested_at"),
    ).repartition(8)
    raw = spark.createDataFrame(base.rdd, files.as_nullable(files.RAW_SALES_SCHEMA))
    cur = etl.curate(raw)
    assert cur.count() == 1 + (n - n // 3)              # one row for the hot key, all others kept
    hot = cur.filter("order_id = 'hot'").collect()[0]
    last_hot = max(i for i in range(n) if i % 3 == 0)
    assert hot.quantity == last_hot % 7 + 1             # newest ingested_at wins


def test_hot_request_key_update_and_latest(spark):
    target = spark.range(100).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("alert_id"),
                                     F.lit(False).alias("acknowledged"),
                                     F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"))
    reqs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("k7")).otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("alert_id"),
        F.timestamp_add("SECOND", F.col("id"), F.lit(T0).cast("timestamp_ntz")).alias("requested_at"))
    snap = {r.alert_id: r for r in U.acknowledge(target, reqs).collect()}
    assert len(snap) == 100 and all(r.acknowledged for r in snap.values())
    assert snap["k7"].acknowledged_at == T0 + dt.timedelta(seconds=2999 if 2999 % 3 == 0 else 2997)
    latest = R.latest_per_key(reqs, "alert_id", "requested_at")
    assert latest.count() == 100
