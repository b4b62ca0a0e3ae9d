"""Metric windows, alarms, transitions and counters."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.operators import forecast as FC
from tidemark.operators import metric_events as ME
from tidemark.operators import metrics as M
from tidemark.operators import records as R
from tidemark.operators import updates as U
from tidemark.operators import validate as Val
from tidemark.plans import views as V
from tidemark.functions import scalars as S
from tidemark.plans.oracle_views import round_exact_sql
from tidemark.plans.registry import register
from tidemark.session import scratch_path
from tidemark.sources import files

_P = 300


def _consecutive(spark, sf):
    return M.alarm_consecutive(M.evaluate_metrics(V.metrics(spark, sf), M.alarm_rules(spark)))


_WEEK = 7 * 86400


@register("window_stats", f"""
SELECT metric_id, period_start, period_end, round(sum, 6) AS sum, max, round(avg, 6) AS avg, samples, p50, p99
FROM window_stats
UNION ALL
SELECT metric_id, ps, ps + to_seconds({_WEEK}), round(sum(value), 6), max(value), round(avg(value), 6), count(*),
       quantile_disc(value, 0.5), quantile_disc(value, 0.99)
FROM (SELECT *, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(floor(epoch(ts) / {_WEEK}) * {_WEEK} AS BIGINT)) AS ps
      FROM metrics) m GROUP BY metric_id, ps""", ("window_stats", "metrics"))
def window_stats(spark, sf):
    """Alarm periods, and weeks, whose many points tell p99 from the maximum."""
    path = scratch_path(spark, "metric_windows")  # the points are counted once; weeks are sums of the stored periods
    files.sink_parquet(M.window_counts(V.metrics(spark, sf)), path)
    counts = spark.read.parquet(path)
    s = M.stats_of_counts(counts).unionByName(M.stats_of_counts(M.roll_up(counts, _WEEK)))
    return s.select("metric_id", "period_start", "period_end", F.round("sum", 6).alias("sum"), "max",
                    F.round("avg", 6).alias("avg"), "samples", "p50", "p99")


def threshold_alarm_batch(spark, sf):
    """Batch twin of the streaming threshold alarm (used by tests)."""
    t = M.threshold_alarm(V.metrics(spark, sf), spark)
    return t.select("alarm", "period_start", F.round("stat_value", 6).alias("stat_value"))


@register("alarm_consecutive", """
SELECT alarm, period_start, round(stat_value, 6) AS stat_value, breach, in_alarm FROM consecutive""",
          ("consecutive",))
def alarm_consecutive(spark, sf):
    c = _consecutive(spark, sf)
    return c.select("alarm", "period_start", F.round("stat_value", 6).alias("stat_value"), "breach", "in_alarm")


@register("alarm_transitions", f"""
SELECT alarm, period_start AS changed_at, 'ALARM' AS state FROM (
  SELECT alarm, period_start, lag(period_start) OVER (PARTITION BY alarm ORDER BY period_start) AS prev
  FROM consecutive WHERE in_alarm) a
WHERE prev IS NULL OR prev <> period_start - to_seconds({_P})
UNION ALL
SELECT alarm, period_start + to_seconds({_P}) AS changed_at, 'OK' AS state FROM (
  SELECT alarm, period_start, lead(period_start) OVER (PARTITION BY alarm ORDER BY period_start) AS nxt
  FROM consecutive WHERE in_alarm) b
WHERE (nxt IS NULL OR nxt <> period_start + to_seconds({_P}))
  AND period_start + to_seconds({_P}) <= (
      SELECT TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(floor(epoch(max(ts)) / {_P}) * {_P} AS BIGINT))
      FROM metrics)""", ("consecutive", "metrics"))
def alarm_transitions(spark, sf):
    now = M.last_period(V.metrics(spark, sf))
    return M.alarm_transitions(_consecutive(spark, sf), last=now).select("alarm", "changed_at", "state")


def _stored(df, name):
    """``df`` written once, for several readers."""
    path = scratch_path(df.sparkSession, name)
    files.sink_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def metric_events(spark, sf):
    """The events of all emission sites over the views.  Demand and forecast records,
    which several sites report on, are made once; no site reports on predictions."""
    artifacts = U.report_generate(V.reports(spark, sf), V.report_requests(spark, sf))[1]
    demand = _stored(V.demand_history(spark, sf), "metric_demand")
    forecasts = _stored(V.forecasts(spark, sf, demand).drop("predictions"), "metric_forecasts")
    requests = Val.validate_inference_request(V.inference_requests(spark, sf, demand)).filter(F.col("status_code") == 200)
    parts = [
        ME.alerts_created(V.alerts(spark, sf)),
        ME.forecasts_retrieved(R.forecasts_by_product(V.forecast_runs(spark, sf, forecasts))),
        ME.forecast_generated(forecasts),
        ME.forecast_accuracy(forecasts),
        ME.direct_inference(requests),
        ME.optimization_run_started(U.scenario_run_record(V.scenarios(spark, sf), V.scenario_run_requests(spark, sf))[1]),
        ME.optimization_applied(U.apply_if_proposed(V.optimizations(spark, sf), V.apply_requests(spark, sf))[1]),
        ME.report_generated(artifacts),
        ME.access_control_changed(U.access_replace(V.access_controls(spark, sf), V.access_requests(spark, sf))[2]),
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@register("sink_metric_event", "SELECT namespace, metric_name, value, unit, dimensions, source_key FROM metric_events",
          ("metric_events",))
def sink_metric_event(spark, sf):
    path = scratch_path(spark, "metric_events")
    files.emit_metrics(metric_events(spark, sf), path, "batch-1")  # best effort: a failure never fails the caller
    return files.read_runs(spark, path)


@register("metric_sum_by_dimension", """
SELECT namespace, metric_name, dimensions, sum(value) AS total, count(*) AS events FROM metric_events
GROUP BY namespace, metric_name, dimensions""", ("metric_events",))
def metric_sum_by_dimension(spark, sf):
    return M.metric_sum_by_dimension(metric_events(spark, sf))


@register("forecast_accuracy_metric", f"""
SELECT product_id, 'ForecastAccuracy' AS metric_name, 'Percent' AS unit,
       {round_exact_sql('avg(accuracy)', 4, 'up')} AS accuracy_avg, count(*) AS points
FROM (SELECT f.product_id,
             CASE WHEN f.demand <> 0 THEN {round_exact_sql('CAST(a.demand AS DOUBLE) * 100 / f.demand', 1, 'up')} END AS accuracy
      FROM backtest_preds f JOIN demand_history a ON f.product_id = a.product_id AND f.period = a.period) t
WHERE accuracy IS NOT NULL GROUP BY product_id""", ("backtest_preds", "demand_history"))
def forecast_accuracy_metric(spark, sf):
    tested = FC.backtest(V.demand_history(spark, sf), V.BACKTEST_CUTOFF, V.FORECAST_HORIZON)
    return (tested.filter(F.col("accuracy").isNotNull())
                  .groupBy("product_id")
                  .agg(S.round_exact(F.avg("accuracy"), 4, "up").alias("accuracy_avg"), F.count(F.lit(1)).alias("points"))
                  .select("product_id", F.lit("ForecastAccuracy").alias("metric_name"), F.lit("Percent").alias("unit"),
                          "accuracy_avg", "points"))
