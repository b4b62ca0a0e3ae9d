"""Record reads: scans, index reads, latest-per-series, counts, sorts, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars as S
from tidemark.operators import metrics as M
from tidemark.operators import records as R
from tidemark.plans import stored, views as V
from tidemark.plans.oracle_views import q, severity_rank_sql
from tidemark.plans.registry import register
from tidemark.session import scratch_path
from tidemark.sources import files

AS_OF_EPOCH = 1706745600  # 2024-02-01 00:00:00 UTC, retention cut for ttl_retention

_RULED_SERIES = sorted({f"{r[1]}:{r[2]}" for r in vocab.ALARM_RULES})


@register("scan_entity", """
SELECT alert_id, alert_type, category, title, message, ts, source, acknowledged, action_required FROM alerts""",
          ("alerts",))
def scan_entity(spark, sf):
    return V.alerts(spark, sf).select("alert_id", "alert_type", "category", "title", "message", "ts", "source",
                                      "acknowledged", "action_required")


def _ordered(rows, key, order, *columns):
    """Rows of an unlimited read with their position, so that the order is compared."""
    return R.with_positions(rows, key, order).select(*columns, "pos")


def _positions(columns: str, table: str, key: str, order: str) -> str:
    return f"SELECT {columns}, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {order}) AS pos FROM {table}"


@register("scan_index_eq", _positions("metric_id, ts, value", f"""(
  SELECT * FROM metrics WHERE metric_id IN ({', '.join(q(s) for s in _RULED_SERIES)})) m""", "metric_id",
                                      "ts DESC, value"), ("metrics",))
def scan_index_eq(spark, sf):
    """Read the series that the alarm rules watch from the stored index of the metrics."""
    metrics = stored.index(spark, sf, "metrics", "metric_id", R.series_order())
    rows = R.scan_index_eq(metrics, "metric_id", _RULED_SERIES, R.series_order())
    return _ordered(rows, "metric_id", R.series_order(), "metric_id", "ts", "value")


@register("get_by_key", """
SELECT r.report_id, r.requested_at, p.title, p.report_type, p.report_id IS NOT NULL AS found
FROM report_requests r LEFT JOIN reports p ON r.report_id = p.report_id""", ("report_requests", "reports"))
def get_by_key(spark, sf):
    requests = V.report_requests(spark, sf)
    held = stored.keyed(spark, sf, "reports", "report_id").lookup(requests)
    return R.get_by_key(held.select("report_id", "title", "report_type"), requests, "report_id") \
            .select("report_id", "requested_at", "title", "report_type", "found")


@register("forecasts_by_product", f"""
SELECT forecast_id, product_id, created_at,
       CAST(ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY created_at DESC NULLS LAST, forecast_id DESC) AS INTEGER) AS pos
FROM forecast_runs QUALIFY pos <= {vocab.DEFAULT_PAGE_SIZE}""", ("forecast_runs",))
def forecasts_by_product(spark, sf):
    """The newest 50 forecasts per product (the route's page size) of 60 nightly runs."""
    return R.forecasts_by_product(V.forecast_runs(spark, sf)).select("forecast_id", "product_id", "created_at", "pos")


@register("alerts_by_category", _positions("category, alert_id, ts", "alerts", "category", "ts DESC NULLS LAST, alert_id"),
          ("alerts",))
def alerts_by_category(spark, sf):
    return _ordered(R.alerts_by_category(V.alerts(spark, sf)), "category", R.newest("ts", "alert_id"),
                    "category", "alert_id", "ts")


@register("inventory_alerts_by_product",
          _positions("product_id, alert_id, severity", "inventory_alerts", "product_id", "severity, alert_id"),
          ("inventory_alerts",))
def inventory_alerts_by_product(spark, sf):
    """Every alert of every product: the read has no limit."""
    rows = R.inventory_alerts_by_product(V.inventory_alerts(spark, sf))
    return _ordered(rows, "product_id", [F.col("severity"), F.col("alert_id")], "product_id", "alert_id", "severity")


@register("kpi_history", _positions("kpi_id, ts, value", "kpis", "kpi_id", "ts DESC NULLS LAST, label, value, trend"),
          ("kpis",))
def kpi_history(spark, sf):
    return _ordered(R.kpi_history(V.kpis(spark, sf)), "kpi_id", R.kpi_order(), "kpi_id", "ts", "value")


@register("metric_series", _positions("metric_id, ts, value, unit", "metrics", "metric_id", "ts DESC NULLS LAST, value"),
          ("metrics",))
def metric_series(spark, sf):
    return _ordered(R.metric_series(V.metrics(spark, sf)), "metric_id", R.series_order(), "metric_id", "ts", "value", "unit")


@register("data_sources_by_type",
          _positions("source_type, source_id, name, status", "data_sources", "source_type", "source_id"), ("data_sources",))
def data_sources_by_type(spark, sf):
    return _ordered(R.data_sources_by_type(V.data_sources(spark, sf)), "source_type", [F.col("source_id")],
                    "source_type", "source_id", "name", "status")


@register("insights_by_category", _positions("category, insight_id, created_at, impact", "insights", "category",
                                             "created_at DESC NULLS LAST, insight_id"), ("insights",))
def insights_by_category(spark, sf):
    return _ordered(R.insights_by_category(V.insights(spark, sf)), "category", R.newest("created_at", "insight_id"),
                    "category", "insight_id", "created_at", "impact")


@register("access_by_role", _positions("role, user_id, name, status", "access_controls", "role", "user_id"),
          ("access_controls",))
def access_by_role(spark, sf):
    return _ordered(R.access_by_role(V.access_controls(spark, sf)), "role", [F.col("user_id")],
                    "role", "user_id", "name", "status")


@register("governance_series", _positions("metric_id, ts, value, status", "governance_metrics", "metric_id",
                                          "ts DESC NULLS LAST, value"), ("governance_metrics",))
def governance_series(spark, sf):
    return _ordered(R.governance_series(V.governance_metrics(spark, sf)), "metric_id", R.series_order(),
                    "metric_id", "ts", "value", "status")


@register("bias_by_model", _positions("model_component, detection_id, detected_at, severity", "bias_detections",
                                      "model_component", "detected_at DESC NULLS LAST, detection_id"), ("bias_detections",))
def bias_by_model(spark, sf):
    return _ordered(R.bias_by_model(V.bias_detections(spark, sf)), "model_component", R.newest("detected_at", "detection_id"),
                    "model_component", "detection_id", "detected_at", "severity")


@register("filter_unacknowledged", "SELECT alert_id, category, acknowledged FROM alerts WHERE NOT COALESCE(acknowledged, FALSE)",
          ("alerts",))
def filter_unacknowledged(spark, sf):
    return R.filter_unacknowledged(V.alerts(spark, sf)).select("alert_id", "category", "acknowledged")


@register("latest_kpi_per_series", """
SELECT kpi_id, ts, value, trend FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY kpi_id ORDER BY ts DESC NULLS LAST, label DESC, value DESC, trend DESC) AS rn
  FROM kpis) t WHERE rn = 1""", ("kpis",))
def latest_kpi_per_series(spark, sf):
    return R.latest_kpi_per_series(V.kpis(spark, sf)).select("kpi_id", "ts", "value", "trend")


@register("list_count", "SELECT category, count(*) AS count FROM alerts GROUP BY category", ("alerts",))
def list_count(spark, sf):
    return R.list_count(V.alerts(spark, sf), "category")


@register("alerts_unacknowledged_count", """
SELECT count(*) AS count, count(*) FILTER (WHERE NOT COALESCE(acknowledged, FALSE)) AS unacknowledged FROM alerts""",
          ("alerts",))
def alerts_unacknowledged_count(spark, sf):
    return R.alerts_unacknowledged_count(V.alerts(spark, sf))


@register("critical_inventory_count",
          "SELECT count(*) FILTER (WHERE severity = 'critical') AS critical_count FROM inventory_alerts",
          ("inventory_alerts",))
def critical_inventory_count(spark, sf):
    return R.critical_inventory_count(V.inventory_alerts(spark, sf))


@register("ingestion_stats", """
SELECT CAST(sum(records_processed) AS BIGINT) AS total_records,
       CAST(floor(sum(records_processed) * 0.05) AS BIGINT) AS processed_today,
       floor(avg(data_quality) * 10 + 0.5) / 10.0 AS data_quality_avg,
       floor(count(*) FILTER (WHERE status = 'active') / count(*) * 100 * 10 + 0.5) / 10.0 AS pipeline_health
FROM data_sources""", ("data_sources",))
def ingestion_stats(spark, sf):
    return M.ingestion_stats(V.data_sources(spark, sf))


@register("quality_band", """
SELECT source_id, data_quality, CASE WHEN data_quality > 95 THEN 'green' WHEN data_quality > 90 THEN 'yellow'
       ELSE 'red' END AS band FROM data_sources""", ("data_sources",))
def quality_band(spark, sf):
    d = V.data_sources(spark, sf)
    return d.select("source_id", "data_quality", S.quality_band("data_quality").alias("band"))


@register("sort_newest_first", _positions("report_id, created_at", "reports", "1", "created_at DESC NULLS LAST, report_id"),
          ("reports",))
def sort_newest_first(spark, sf):
    rows = R.sort_newest_first(V.reports(spark, sf), "created_at", "report_id")
    return _ordered(rows, None, R.newest("created_at", "report_id"), "report_id", "created_at")


_PAGE_OF = f"CAST(floor((ROW_NUMBER() OVER (ORDER BY alert_id NULLS LAST) - 1) / {vocab.DEFAULT_PAGE_SIZE}) + 1 AS BIGINT)"


@register("page_keyset", f"SELECT alert_id, {_PAGE_OF} AS page FROM alerts", ("alerts",))
def page_keyset(spark, sf):
    """Every alert with the page that the cursor reaches it on."""
    alerts = stored.keyed(spark, sf, "alerts", "alert_id").read()
    return R.paged(alerts.select("alert_id"), "alert_id", vocab.DEFAULT_PAGE_SIZE)


@register("page_directory", f"""
SELECT page, min(alert_id) AS first_key, CASE WHEN count(*) = count(alert_id) THEN max(alert_id) END AS last_key,
       count(*) AS n_rows, page < max(max(page)) OVER () AS has_next
FROM (SELECT alert_id, {_PAGE_OF} AS page FROM alerts) p GROUP BY page""", ("alerts",))
def page_directory(spark, sf):
    """The border keys of all pages."""
    alerts = stored.keyed(spark, sf, "alerts", "alert_id").read()
    return R.page_directory(alerts, "alert_id", vocab.DEFAULT_PAGE_SIZE)


@register("top3_alerts", f"""
SELECT alert_id, severity, {severity_rank_sql('severity')} AS severity_rank FROM inventory_alerts
ORDER BY severity_rank, alert_id LIMIT 3""", ("inventory_alerts",))
def top3_alerts(spark, sf):
    return R.top_alerts(V.inventory_alerts(spark, sf), 3).select("alert_id", "severity", "severity_rank")


@register("ttl_retention", f"SELECT kpi_id, ts, ttl FROM kpis WHERE ttl IS NULL OR ttl > {AS_OF_EPOCH}", ("kpis",))
def ttl_retention(spark, sf):
    """Rows laid out by the day they expire: retention removes whole days, and the read
    opens no folder of a past one."""
    path = scratch_path(spark, "kpis_by_expiry")
    files.sink_expiring(V.kpis(spark, sf), path, "load-1")
    files.drop_expired(spark, path, AS_OF_EPOCH)
    return files.read_unexpired(spark, path, AS_OF_EPOCH).select("kpi_id", "ts", "ttl")
