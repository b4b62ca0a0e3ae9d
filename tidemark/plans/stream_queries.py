"""Streaming queries: run with ``availableNow`` over files staged from the
views, then read the sink back.  Windows that the stream still holds open at the
end (window end > newest event time - lateness) are added with ``closed`` false."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.operators import metrics as M
from tidemark.plans import views as V
from tidemark.plans.alert_queries import INTAKE_TIME, SUBJECT_PREFIX, _NOTIFY_SQL
from tidemark.plans.registry import register
from tidemark.session import scratch_path
from tidemark.sources import files
from tidemark.streaming import alarms as ST

_CLOSED = "{} <= (SELECT max(ts) FROM metrics) - INTERVAL 10 MINUTE"
assert vocab.DEFAULT_LATENESS == "10 minutes"


def _intake(spark, sf):
    base = scratch_path(spark, "alarm_intake")
    files.sink_text(V.alarm_events(spark, sf).select("payload"), f"{base}/landing")
    ST.run_alarm_intake(spark, f"{base}/landing", f"{base}/out", f"{base}/_checkpoint", SUBJECT_PREFIX,
                        received_at=F.lit(INTAKE_TIME))
    return base


def _staged_metrics(spark, sf):
    base = scratch_path(spark, "metric_stream")
    m = V.metrics(spark, sf)
    files.sink_parquet(m, f"{base}/landing")
    return base, m.schema


_INTAKE_TS = f"CASE WHEN has_time THEN ts ELSE TIMESTAMP '{INTAKE_TIME:%Y-%m-%d %H:%M:%S}' END"


@register("stream_alarm_intake", f"""
SELECT alert_id, alert_type, category, title, message, source, action_required, {_INTAKE_TS} AS ts
FROM alerts""", ("alerts",))
def stream_alarm_intake(spark, sf):
    base = _intake(spark, sf)
    a = spark.read.parquet(f"{base}/out/alerts")
    return a.select("alert_id", "alert_type", "category", "title", "message", "source", "action_required", "ts")


@register("stream_critical_fanout", _NOTIFY_SQL.replace("FROM alerts", f"FROM (SELECT * REPLACE ({_INTAKE_TS} AS ts) FROM alerts) a"),
          ("alerts",))
def stream_critical_fanout(spark, sf):
    base = _intake(spark, sf)
    return spark.read.parquet(f"{base}/out/notifications").select("alert_id", "subject", "body")


def _with_open(closed, still_open):
    """What the stream emitted and the windows it still holds."""
    return closed.withColumn("closed", F.lit(True)).unionByName(still_open.withColumn("closed", F.lit(False)))


def _tumbling_sql(period: int) -> str:
    return f"""
SELECT metric_id, ps AS period_start, ps + to_seconds({period}) AS period_end, round(sum(value), 6) AS sum,
       max(value) AS max, count(*) AS samples, quantile_disc(value, 0.99) AS p99, {period} AS period_seconds,
       {_CLOSED.format(f'ps + to_seconds({period})')} AS closed
FROM (SELECT *, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(floor(epoch(ts) / {period}) * {period} AS BIGINT)) AS ps
      FROM metrics) m
GROUP BY metric_id, ps"""


TUMBLING_PERIODS = (300, 3600)  # 5-minute alarm periods and hourly business sums


@register("stream_tumbling_metrics", " UNION ALL ".join(_tumbling_sql(p) for p in TUMBLING_PERIODS), ("metrics",))
def stream_tumbling_metrics(spark, sf):
    base, schema = _staged_metrics(spark, sf)
    landing = spark.read.schema(schema).parquet(f"{base}/landing")
    out = None
    for period in TUMBLING_PERIODS:
        ST.run_tumbling_metrics(spark, f"{base}/landing", schema, f"{base}/out_{period}",
                                f"{base}/_checkpoint_{period}", period_seconds=period)
        s = _with_open(spark.read.parquet(f"{base}/out_{period}").drop("batch_id"), ST.open_stats(landing, period)).select(
            "metric_id", "period_start", "period_end", F.round("sum", 6).alias("sum"), "max", "samples", "p99",
            F.lit(period).alias("period_seconds"), "closed")
        out = s if out is None else out.unionByName(s)
    return out


@register("stream_threshold_alarm", f"""
SELECT alarm, period_start, round(stat_value, 6) AS stat_value, {_CLOSED.format('period_end')} AS closed
FROM evaluated WHERE breach""", ("evaluated", "metrics"))
def stream_threshold_alarm(spark, sf):
    base, schema = _staged_metrics(spark, sf)
    ST.run_threshold_alarm(spark, f"{base}/landing", schema, f"{base}/out", f"{base}/_checkpoint")
    landing = spark.read.schema(schema).parquet(f"{base}/landing")
    still_open = M.evaluate_rules(ST.open_stats(landing, group=M.RULED), M.alarm_rules(spark)).filter("breach")
    s = _with_open(spark.read.parquet(f"{base}/out").drop("batch_id"), still_open)
    return s.select("alarm", "period_start", F.round("stat_value", 6).alias("stat_value"), "closed")


def _consecutive_sql() -> str:
    p = vocab.ALARM_PERIOD_SECONDS
    parts = []
    for n in sorted({r[6] for r in vocab.ALARM_RULES}):
        starts = ", ".join(f"period_start - to_seconds({k * p})" for k in range(n - 1, -1, -1))
        parts.append(f"""
SELECT alarm, periods, ws AS window_start, ws + to_seconds({n * p}) AS window_end,
       count(*) FILTER (WHERE breach) AS breaching_periods, count(*) AS periods_with_data,
       count(*) FILTER (WHERE breach) = {n} AS in_alarm, {_CLOSED.format(f'ws + to_seconds({n * p})')} AS closed
FROM (SELECT alarm, periods, breach, unnest([{starts}]) AS ws FROM evaluated WHERE periods = {n}) x
GROUP BY alarm, periods, ws""")
    return " UNION ALL ".join(parts)


@register("stream_consecutive_alarm", _consecutive_sql(), ("evaluated", "metrics"))
def stream_consecutive_alarm(spark, sf):
    base, schema = _staged_metrics(spark, sf)
    rules = M.alarm_rules(spark)
    ST.run_consecutive_alarm(spark, f"{base}/landing", schema, f"{base}/out", f"{base}/_checkpoint", rules=rules)
    landing = spark.read.schema(schema).parquet(f"{base}/landing")
    s = _with_open(ST.closed_windows(spark, f"{base}/out"), ST.open_consecutive(landing, rules))
    return s.select("alarm", "periods", "window_start", "window_end", "breaching_periods", "periods_with_data",
                    "in_alarm", "closed")


def _changes_sql() -> str:
    """State changes at periods that have closed: ``changed_at`` is a period's start."""
    p = vocab.ALARM_PERIOD_SECONDS
    ended = _CLOSED.format(f"changed_at + to_seconds({p})")
    return f"""
SELECT alarm, changed_at, state FROM (
  SELECT alarm, period_start AS changed_at, 'ALARM' AS state FROM (
    SELECT alarm, period_start, lag(period_start) OVER (PARTITION BY alarm ORDER BY period_start) AS prev
    FROM consecutive WHERE in_alarm) a
  WHERE prev IS NULL OR prev <> period_start - to_seconds({p})
  UNION ALL
  SELECT alarm, period_start + to_seconds({p}), 'OK' FROM (
    SELECT alarm, period_start, lead(period_start) OVER (PARTITION BY alarm ORDER BY period_start) AS nxt
    FROM consecutive WHERE in_alarm) b
  WHERE nxt IS NULL OR nxt <> period_start + to_seconds({p})) c
WHERE {ended}"""


@register("stream_alarm_transitions", _changes_sql(), ("consecutive", "metrics"))
def stream_alarm_transitions(spark, sf):
    """State changes as the stream reports them, all rules in one query."""
    base, schema = _staged_metrics(spark, sf)
    ST.run_consecutive_alarm(spark, f"{base}/landing", schema, f"{base}/out", f"{base}/_checkpoint")
    return ST.state_changes(spark, f"{base}/out")
