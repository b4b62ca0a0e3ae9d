"""Forecast queries: demand history, baseline and pandas scoring, records, accuracy."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars as S
from tidemark.operators import etl
from tidemark.operators import forecast as FC
from tidemark.operators import validate as Val
from tidemark.plans import views as V
from tidemark.plans.oracle_views import baseline_sql, forecast_id_sql, next_period_sql, q, round_exact_sql
from tidemark.plans.registry import register
from tidemark.session import scratch_path
from tidemark.sources import parts, versions

LAST_INTAKE = dt.datetime(2001, 7, 1)  # what came in from here on is new in the second night
WHAT_IF_SCALE = 1.5
WHAT_IF_HORIZON = 3


def _valid_requests(spark, sf):
    r = Val.validate_inference_request(V.inference_requests(spark, sf))
    return r.filter(F.col("status_code") == 200).select("product_id", "history", "horizon")


@register("monthly_demand", "SELECT product_id, period, demand FROM demand_history", ("demand_history",))
def monthly_demand(spark, sf):
    return FC.monthly_demand(V.curated_sales(spark, sf))


def refresh_demand(curated):
    """The monthly demand of some curated months, with the columns that name the month."""
    d = FC.monthly_demand(curated)
    return d.withColumns({"year": F.substring("period", 1, 4).cast("int"), "month": F.substring("period", 6, 2).cast("int")})


@register("monthly_demand_refreshed", "SELECT product_id, period, demand FROM demand_history", ("demand_history",))
def monthly_demand_refreshed(spark, sf):
    """Two nights: the first without the orders that came in last, the second with all.
    The second refresh aggregates the months that changed and keeps the others."""
    raw = V.sales_by_order(spark, sf)
    curated, demand = scratch_path(spark, "curated_parts"), scratch_path(spark, "demand_parts")
    months = ("year", "month")
    for night in (raw.filter(F.col("ingested_at").isNull() | (F.col("ingested_at") < LAST_INTAKE)), raw):
        parts.publish_parts(etl.curate(night, (V.SALES_ORDER,), dealt=True), curated, months, dealt=True)
        parts.refresh(spark, curated, demand, months, refresh_demand)
    return parts.read_parts(spark, versions.latest(spark, demand)).select("product_id", "period", "demand")


@register("collect_history", """
SELECT product_id, CAST(count(*) AS INTEGER) AS n_points, min(period) AS first_period, max(period) AS last_period,
       string_agg(period || ':' || CAST(demand AS VARCHAR), ',' ORDER BY period) AS history
FROM demand_history GROUP BY product_id""", ("demand_history",))
def collect_history(spark, sf):
    h = FC.collect_history(V.demand_history(spark, sf))
    text = F.array_join(F.transform("history", lambda x: F.concat(x["period"], F.lit(":"),
                                                                   x["demand"].cast("bigint").cast("string"))), ",")
    return h.select("product_id", F.size("history").alias("n_points"),
                    F.element_at("history", 1)["period"].alias("first_period"),
                    F.element_at("history", -1)["period"].alias("last_period"), text.alias("history"))


@register("context_tail", """
SELECT product_id, period, demand, context FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY period DESC) AS rn FROM demand_history) t
JOIN (SELECT unnest([96, 12]) AS context) c ON rn <= context""", ("demand_history",))
def context_tail(spark, sf):
    """The model context of 96 months, and a context of 12 that cuts most histories."""
    h = FC.collect_history(V.demand_history(spark, sf))
    tails = F.explode(F.array(*[F.struct(F.lit(n).alias("context"), S.context_tail(F.col("history"), n).alias("tail"))
                                for n in (vocab.CONTEXT_LENGTH, 12)])).alias("c")
    t = h.select("product_id", tails).select("product_id", "c.context", F.explode("c.tail").alias("p"))
    return t.select("product_id", F.col("p.period").alias("period"), F.col("p.demand").cast("bigint").alias("demand"), "context")


@register("round2", f"SELECT product_id, {round_exact_sql('avg(demand)', 2)} AS mean_demand FROM demand_history GROUP BY product_id",
          ("demand_history",))
def round2(spark, sf):
    h = V.demand_history(spark, sf)
    return h.groupBy("product_id").agg(S.round_half_even(F.avg("demand"), 2).alias("mean_demand"))


_SHORT = 24  # months: a context that cuts the histories at hand


@register("baseline_quantiles", " UNION ALL ".join(
    f"SELECT product_id, step, period, demand, lower, upper, {n} AS context FROM ({baseline_sql('demand_history', 6, context=n)}) t"
    for n in (vocab.CONTEXT_LENGTH, _SHORT)), ("demand_history",))
def baseline_quantiles(spark, sf):
    monthly = V.demand_history(spark, sf)
    both = [FC.baseline_quantiles(monthly, horizon=6, context=n).withColumn("context", F.lit(n))
            for n in (vocab.CONTEXT_LENGTH, _SHORT)]
    return both[0].unionByName(both[1]).select("product_id", "step", "period", "demand", "lower", "upper", "context")


@register("score_forecast",
          f"SELECT product_id, step, period, demand, lower, upper FROM ({baseline_sql('inference_valid', 'horizon')}) t",
          ("inference_valid",))
def score_forecast(spark, sf):
    return FC.score_forecast(_valid_requests(spark, sf)).select("product_id", "step", "period", "demand", "lower", "upper")


@register("what_if_score", f"""
SELECT product_id, step, period, demand, lower, upper FROM (
  {baseline_sql('inference_valid', WHAT_IF_HORIZON, demand_expr=f'CAST(demand AS DOUBLE) * {WHAT_IF_SCALE}')}) t""",
          ("inference_valid",))
def what_if_score(spark, sf):
    r = _valid_requests(spark, sf).select(
        "product_id", F.lit(WHAT_IF_HORIZON).alias("horizon"),
        F.transform("history", lambda x: F.struct(x["period"].alias("period"),
                                                  (x["demand"] * WHAT_IF_SCALE).alias("demand"))).alias("history"))
    return FC.score_forecast(r).select("product_id", "step", "period", "demand", "lower", "upper")


@register("next_periods", f"""
SELECT product_id, step, {next_period_sql('last_period', 'step')} AS period FROM (
  SELECT product_id, last_period, CAST(unnest(generate_series(1, horizon)) AS INTEGER) AS step
  FROM (SELECT product_id, max(period) AS last_period, max(horizon) AS horizon FROM inference_valid GROUP BY 1) a) b""",
          ("inference_valid",))
def next_periods(spark, sf):
    r = _valid_requests(spark, sf)
    last = F.element_at("history", -1)["period"]
    return r.select("product_id", F.posexplode(S.next_periods(last, F.col("horizon"))).alias("i", "period")) \
            .select("product_id", (F.col("i") + 1).alias("step"), "period")


@register("validate_inference_request", """
SELECT product_id, horizon,
       CASE WHEN n_points = 0 THEN 400 WHEN n_points > n_demands THEN 400 WHEN horizon NOT BETWEEN 1 AND 24 THEN 400 ELSE 200 END
         AS status_code,
       CASE WHEN n_points = 0 THEN 'historicalData must be a non-empty array'
            WHEN n_points > n_demands THEN 'historicalData points must have a demand'
            WHEN horizon NOT BETWEEN 1 AND 24 THEN 'forecastHorizon must be an integer between 1 and 24' END AS error
FROM (SELECT product_id, max(horizon) AS horizon, count(period) AS n_points, count(demand) AS n_demands
      FROM inference_requests GROUP BY product_id) r""", ("inference_requests",))
def validate_inference_request(spark, sf):
    r = Val.validate_inference_request(V.inference_requests(spark, sf))
    return r.select("product_id", "horizon", "status_code", "error")


@register("forecast_record", f"""
SELECT {forecast_id_sql('product_id')} AS forecast_id, product_id, CAST(count(*) AS INTEGER) AS n_predictions,
       min(period) AS first_period, sum(demand) AS total_demand, CAST(0.8 AS DOUBLE) AS confidence,
       CAST(NULL AS DOUBLE) AS accuracy, {q(V.BASELINE_MODEL_VERSION)} AS model_version, 'active' AS status,
       TIMESTAMP '{V.FORECAST_AS_OF:%Y-%m-%d %H:%M:%S}' AS created_at
FROM ({baseline_sql('inference_valid', 'horizon')}) t GROUP BY product_id""", ("inference_valid",))
def forecast_record(spark, sf):
    """Create-forecast end to end: validate, score, store the model's output."""
    f = FC.forecast_record(FC.score_forecast(_valid_requests(spark, sf)), V.FORECAST_AS_OF, V.BASELINE_MODEL_VERSION)
    return f.select("forecast_id", "product_id", F.size("predictions").alias("n_predictions"),
                    F.element_at("predictions", 1)["period"].alias("first_period"),
                    F.aggregate("predictions", F.lit(0.0), lambda a, x: a + x["demand"]).alias("total_demand"),
                    "confidence", "accuracy", "model_version", "status", "created_at")


@register("interval_confidence", """
SELECT product_id, round(CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE), 4) AS confidence, count(*) AS steps
FROM (SELECT product_id, CAST(unnest(generate_series(1, h)) AS INTEGER) AS step
      FROM (SELECT product_id, max(horizon) AS h FROM inference_valid GROUP BY 1) a) s GROUP BY 1""", ("inference_valid",))
def interval_confidence(spark, sf):
    """The confidence that the model states with each prediction."""
    scored = FC.score_forecast(_valid_requests(spark, sf))
    return scored.groupBy("product_id", "confidence").agg(F.count(F.lit(1)).alias("steps"))


@register("forecast_vs_actual", f"""
SELECT f.product_id, f.period, f.step, f.demand, CAST(a.demand AS DOUBLE) AS actual,
       CASE WHEN a.demand IS NOT NULL AND f.demand <> 0
            THEN {round_exact_sql('CAST(a.demand AS DOUBLE) * 100 / f.demand', 1, 'up')} END AS accuracy
FROM backtest_preds f LEFT JOIN demand_history a ON f.product_id = a.product_id AND f.period = a.period""",
          ("backtest_preds", "demand_history"))
def forecast_vs_actual(spark, sf):
    return FC.backtest(V.demand_history(spark, sf), V.BACKTEST_CUTOFF, V.FORECAST_HORIZON).select(
        "product_id", "period", "step", "demand", "actual", "accuracy")


@register("latest_forecast", """
SELECT f.forecast_id, p.step, p.period, p.demand, p.lower, p.upper
FROM fc_preds p JOIN (SELECT * FROM forecasts ORDER BY created_at DESC NULLS LAST, forecast_id DESC LIMIT 1) f
  ON p.product_id = f.product_id""", ("fc_preds", "forecasts"))
def latest_forecast(spark, sf):
    return FC.latest_forecast(V.forecasts(spark, sf)).select("forecast_id", "step", "period", "demand", "lower", "upper")
