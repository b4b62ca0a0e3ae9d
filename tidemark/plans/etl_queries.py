"""ETL queries: sources, sinks, projections, filters, dedupe, counts, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars as S
from tidemark.operators import etl
from tidemark.plans import views as V
from tidemark.plans.etl_job import run_etl
from tidemark.plans.registry import register
from tidemark.session import scratch_path
from tidemark.sources import files

RAW_COLS = "order_id, product_id, order_date, quantity, unit_price, warehouse_id, channel, ingested_at"
CURATED_COLS = "order_id, product_id, order_date, quantity, unit_price, line_total, warehouse_id, channel, year, month"


def _reasons_text(df):
    return df.withColumn("reject_reason", F.array_join("reject_reason", ","))


@register("scan_csv_schema", f"SELECT {RAW_COLS} FROM sales_raw", ("sales_raw",))
def scan_csv_schema(spark, sf):
    path = scratch_path(spark, "raw_sales_csv")
    files.write_csv(V.sales_raw(spark, sf), path)
    return files.scan_csv_schema(spark, path)


@register("sink_parquet_partitioned", f"SELECT {CURATED_COLS} FROM curated", ("curated",))
def sink_parquet_partitioned(spark, sf):
    path = scratch_path(spark, "curated_sales")
    files.publish_snapshot(V.curated_sales(spark, sf), path, ("year", "month"))
    return files.read_snapshot(spark, path).select(*[c.strip() for c in CURATED_COLS.split(",")])


@register("sink_quarantine", f"SELECT {RAW_COLS}, reject_reason FROM quarantine", ("quarantine",))
def sink_quarantine(spark, sf):
    path = scratch_path(spark, "quarantine_sales")
    files.sink_parquet(etl.project_drop(etl.filter_quarantine(etl.classify(V.sales_raw(spark, sf)))), path)
    return _reasons_text(spark.read.parquet(path)).select(*[c.strip() for c in RAW_COLS.split(",")], "reject_reason")


@register("catalog_partitions",
          "SELECT year, month, count(*) AS row_count, sum(line_total) AS revenue FROM curated GROUP BY year, month",
          ("curated",))
def catalog_partitions(spark, sf):
    import uuid
    path = scratch_path(spark, "curated_catalog")
    files.sink_parquet_partitioned(V.curated_sales(spark, sf), path)
    name = f"curated_sales_{uuid.uuid4().hex[:12]}"
    t = files.catalog_table(spark, name, path)  # partitions recovered
    out = scratch_path(spark, "curated_months")
    files.sink_parquet(t.groupBy("year", "month").agg(F.count(F.lit(1)).alias("row_count"),
                                                      F.sum("line_total").alias("revenue")), out)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return spark.read.parquet(out)


@register("sink_metrics_batch", """
SELECT metric_name, value, 'Count' AS unit, 'prod' AS environment FROM (
  SELECT 'RowsRead' AS metric_name, CAST(count(*) AS DOUBLE) AS value FROM sales_raw
  UNION ALL SELECT 'RowsCurated', CAST(count(*) AS DOUBLE) FROM curated
  UNION ALL SELECT 'RowsQuarantined', CAST(count(*) AS DOUBLE) FROM quarantine) t""", ("curated", "quarantine"))
def sink_metrics_batch(spark, sf):
    base = scratch_path(spark, "etl_run")
    run_etl(spark, V.sales_raw(spark, sf), f"{base}/curated", f"{base}/quarantine", "night-1", f"{base}/metrics")
    return files.read_runs(spark, f"{base}/metrics").select("metric_name", "value", "unit", "environment")


@register("project_curated", f"SELECT {CURATED_COLS} FROM curated", ("curated",))
def project_curated(spark, sf):
    deduped = etl.dedupe_latest(etl.filter_valid_sales(etl.classify(V.sales_raw(spark, sf))))
    return etl.project_curated(deduped)


@register("project_drop", f"SELECT {RAW_COLS}, reject_reason FROM quarantine", ("quarantine",))
def project_drop(spark, sf):
    q = etl.project_drop(etl.filter_quarantine(etl.classify(V.sales_raw(spark, sf))))
    return _reasons_text(q).select(*[c.strip() for c in RAW_COLS.split(",")], "reject_reason")


@register("filter_valid_sales",
          "SELECT order_id, product_id, order_date, quantity, price, ingested_at FROM classified WHERE is_valid",
          ("classified",))
def filter_valid_sales(spark, sf):
    return etl.filter_valid_sales(etl.classify(V.sales_raw(spark, sf))).select(
        "order_id", "product_id", "order_date", "quantity", "price", "ingested_at")


@register("filter_quarantine",
          "SELECT order_id, product_id, quantity, unit_price, reject_reason FROM quarantine", ("quarantine",))
def filter_quarantine(spark, sf):
    q = etl.filter_quarantine(etl.classify(V.sales_raw(spark, sf)))
    return _reasons_text(q).select("order_id", "product_id", "quantity", "unit_price", "reject_reason")


@register("dedupe_latest",
          "SELECT order_id, product_id, ingested_at, price, quantity, warehouse_id FROM deduped",
          ("deduped",))
def dedupe_latest(spark, sf):
    d = etl.dedupe_latest(etl.filter_valid_sales(etl.classify(V.sales_raw(spark, sf))))
    return d.select("order_id", "product_id", "ingested_at", "price", "quantity", "warehouse_id")


@register("etl_row_counts", """
SELECT (SELECT count(*) FROM classified) AS rows_read,
       (SELECT count(*) FROM classified WHERE is_valid) AS rows_valid,
       (SELECT count(*) FROM classified WHERE NOT is_valid) AS rows_quarantined,
       (SELECT count(*) FROM deduped) AS rows_curated""", ("classified", "deduped"))
def etl_row_counts(spark, sf):
    return etl.etl_row_counts(V.sales_raw(spark, sf))


@register("price_to_decimal",
          "SELECT order_id, product_id, unit_price, TRY_CAST(unit_price AS DECIMAL(12,2)) AS price FROM sales_raw",
          ("sales_raw",))
def price_to_decimal(spark, sf):
    r = V.sales_raw(spark, sf)
    return r.select("order_id", "product_id", "unit_price", S.price_to_decimal("unit_price").alias("price"))


@register("line_total", "SELECT order_id, product_id, quantity, unit_price, line_total FROM curated", ("curated",))
def line_total(spark, sf):
    d = etl.dedupe_latest(etl.filter_valid_sales(etl.classify(V.sales_raw(spark, sf))))
    return d.select("order_id", "product_id", "quantity", F.col("price").alias("unit_price"),
                    S.line_total("quantity", "price").alias("line_total"))


@register("default_channel",
          "SELECT COALESCE(channel, 'unknown') AS channel, count(*) AS row_count FROM deduped GROUP BY 1",
          ("deduped",))
def default_channel(spark, sf):
    d = etl.dedupe_latest(etl.filter_valid_sales(etl.classify(V.sales_raw(spark, sf))))
    return d.groupBy(S.default_channel("channel").alias("channel")).agg(F.count(F.lit(1)).alias("row_count"))


@register("year_month", """
SELECT year, month, count(*) AS orders, sum(line_total) AS revenue FROM curated GROUP BY year, month""",
          ("curated",))
def year_month(spark, sf):
    c = V.curated_sales(spark, sf)
    return (c.groupBy(S.year_of("order_date").alias("year"), S.month_of("order_date").alias("month"))
             .agg(F.count(F.lit(1)).alias("orders"), F.sum("line_total").alias("revenue")))


assert vocab.DEFAULT_CHANNEL == "unknown"
