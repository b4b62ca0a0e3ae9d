"""Sales ETL: null-safe split (T1), try_cast (T3), tie-break (T4), idempotent sink (T2)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from tidemark.operators import etl
from tidemark.plans.etl_job import run_etl
from tidemark.session import scratch_path
from tidemark.sources import files

T0 = dt.datetime(2026, 1, 5, 10, 0)


def raw_rows():
    # order_id, product_id, order_date, quantity, unit_price, warehouse, channel, ingested_at
    return [
        ("o1", "p1", T0, 2, "10.50", "w1", "web", T0),                       # good
        (None, "p1", T0, 1, "1.00", "w1", "web", T0),                        # null id
        ("o2", "p2", None, 1, "1.00", "w1", "web", T0),                      # bad date
        ("o3", "p3", T0, None, "1.00", "w1", "web", T0),                     # null quantity (T1)
        ("o4", "p4", T0, 0, "1.00", "w1", "web", T0),                        # zero quantity
        ("o5", "p5", T0, -1, "1.00", "w1", "web", T0),                       # negative
        ("o6", "p6", T0, 1, "abc", "w1", "web", T0),                         # bad price
        ("o7", "p7", T0, 1, "", "w1", "web", T0),                            # empty price
        ("o8", "p8", T0, 1, "12.345", "w1", None, T0),                       # rounds, null channel
        ("o9", "p9", T0, 1, "99999999999.99", "w1", "web", T0),             # overflow -> null
        ("o10", "p10", T0, 3, "5.00", "w2", "web", None),                    # older version (null ingest)
        ("o10", "p10", T0, 4, "6.00", "w3", "web", T0),                      # newer version wins
        ("o11", "p11", dt.datetime(2026, 2, 1), 1, "2.00", "w1", "web", T0),  # second month
        ("o12", "p12", T0, 1, "3.00", "w1", "web", T0),                      # tie: higher price wins
        ("o12", "p12", T0, 1, "4.00", "w1", "web", T0),
    ]


def raw_df(spark):
    return spark.createDataFrame(raw_rows(), files.as_nullable(files.RAW_SALES_SCHEMA))


def test_split_is_null_safe_and_complete(spark):
    typed = etl.classify(raw_df(spark))
    n_valid = etl.filter_valid_sales(typed).count()
    n_quar = etl.filter_quarantine(typed).count()
    assert n_valid + n_quar == len(raw_rows())
    quarantined = {r.order_id for r in etl.filter_quarantine(typed).collect()}
    assert {"o2", "o3", "o4", "o5", "o6", "o7", "o9"} <= quarantined
    reasons = {r.order_id: r.reject_reason for r in etl.filter_quarantine(typed).collect() if r.order_id}
    assert reasons["o3"] == ["bad_quantity"]
    assert reasons["o6"] == ["bad_unit_price"]
    assert all((len(r.reject_reason) == 0) == r.is_valid for r in typed.collect())


def test_price_try_cast(spark):
    typed = etl.classify(raw_df(spark))
    got = {r.order_id: r.price for r in typed.collect()}
    assert got["o8"] == Decimal("12.35")
    assert got["o6"] is None and got["o7"] is None and got["o9"] is None


def test_dedupe_latest_and_projection(spark):
    cur = {r.order_id: r for r in etl.curate(raw_df(spark)).collect()}
    assert cur["o10"].quantity == 4 and cur["o10"].warehouse_id == "w3"
    assert cur["o12"].unit_price == Decimal("4.00")
    assert cur["o8"].channel == "unknown"
    assert cur["o1"].line_total == Decimal("21.00")
    assert (cur["o11"].year, cur["o11"].month) == (2026, 2)
    assert len(cur) == len({(r[0], r[1]) for r in raw_rows() if r[0] in cur})


def test_dedupe_plan_limits_before_shuffle(spark):
    plan = etl.curate(raw_df(spark))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_csv_scan_declared_schema(spark):
    path = scratch_path(spark, "test_csv")
    files.write_csv(raw_df(spark), path)
    back = files.scan_csv_schema(spark, path)
    assert back.schema.names == files.RAW_SALES_SCHEMA.names
    assert back.count() == len(raw_rows())
    bad = spark.createDataFrame([("x", "p", "not-a-date", "zz", "1", "w", "c", "")], "a string, b string, c string, d string, e string, f string, g string, h string")
    p2 = scratch_path(spark, "test_csv_bad")
    bad.write.option("header", "true").csv(p2)
    row = files.scan_csv_schema(spark, p2, keep_corrupt=True).collect()[0]
    assert row.order_date is None and row.quantity is None and row._corrupt_record is not None


@pytest.mark.parametrize("storage", [None, StorageLevel.MEMORY_AND_DISK])
def test_etl_job_counts_and_idempotent(spark, storage):
    base = scratch_path(spark, "test_etl_job")
    raw = raw_df(spark)
    counts = run_etl(spark, raw, f"{base}/cur", f"{base}/quar", "night-1", f"{base}/metrics", storage_level=storage)
    assert counts["RowsRead"] == len(raw_rows())
    assert counts["RowsCurated"] + 0 == etl.curate(raw).count()
    assert counts["RowsRead"] == counts["RowsQuarantined"] + etl.filter_valid_sales(etl.classify(raw)).count()
    first = sorted(map(tuple, files.read_snapshot(spark, f"{base}/cur").collect()))
    run_etl(spark, raw, f"{base}/cur", f"{base}/quar", "night-1", f"{base}/metrics", storage_level=storage)
    second = sorted(map(tuple, files.read_snapshot(spark, f"{base}/cur").collect()))
    assert first == second  # running twice changes nothing
    m = files.read_runs(spark, f"{base}/metrics").collect()
    assert len(m) == 3 and {r.metric_name: r.value for r in m}["RowsRead"] == len(raw_rows())
    assert files.read_snapshot(spark, f"{base}/quar").count() == counts["RowsQuarantined"]


def test_a_row_that_changes_its_month_leaves_no_copy(spark):
    base = scratch_path(spark, "test_etl_month")
    raw = raw_df(spark)
    run_etl(spark, raw, f"{base}/cur", f"{base}/quar", run_id="night-1")
    later = spark.createDataFrame([("o1", "p1", dt.datetime(2026, 3, 1), 5, "10.50", "w1", "web", dt.datetime(2026, 3, 2))],
                                  raw.schema)
    counts = run_etl(spark, raw.union(later), f"{base}/cur", f"{base}/quar", run_id="night-2")
    cur = files.read_snapshot(spark, f"{base}/cur")
    assert cur.count() == counts["RowsCurated"]
    assert [(r.year, r.month, r.quantity) for r in cur.filter("order_id = 'o1'").collect()] == [(2026, 3, 5)]
    assert cur.groupBy("order_id", "product_id").count().filter("count > 1").count() == 0


def test_partition_filter_reaches_scan(spark):
    base = scratch_path(spark, "test_prune")
    files.sink_parquet_partitioned(etl.curate(raw_df(spark)), base)
    df = files.read_partitioned(spark, base).filter((F.col("year") == 2026) & (F.col("month") == 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan
    assert df.count() == 1


def test_curated_key_is_unique(spark):
    from tidemark.plans import views as V
    cur = V.curated_sales(spark, "/root/testdata/sf0.001")
    assert cur.groupBy("order_id", "product_id").count().filter("count > 1").count() == 0
