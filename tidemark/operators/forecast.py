"""Demand history and quantile forecasts per product.

History is pre-aggregated to one row per (product, month) before anything is
collected, so the per-product arrays are bounded by the number of months
(and cut to the model context), never by the sales volume of a hot product.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import vocab
from tidemark.functions import scalars as S


def monthly_demand(curated: DataFrame) -> DataFrame:
    """(product_id, period yyyy-MM, demand = sum(quantity)) from curated sales."""
    return (curated.groupBy("product_id", S.period_of("order_date").alias("period"))
                   .agg(F.sum("quantity").alias("demand")))


def collect_history(monthly: DataFrame) -> DataFrame:
    """One row per product: history array<struct<period, demand>> sorted by period."""
    return (monthly.groupBy("product_id")
                   .agg(F.array_sort(F.collect_list(F.struct("period", F.col("demand").cast("double").alias("demand"))))
                        .alias("history")))


def context_points(monthly: DataFrame, n: int = vocab.CONTEXT_LENGTH) -> DataFrame:
    """The last n monthly points per product (row_number <= n: partial group limit)."""
    w = Window.partitionBy("product_id").orderBy(F.col("period").desc())
    return monthly.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def array_quantile(sorted_values: Column, q: float) -> Column:
    """Interpolated quantile of a non-empty sorted array of doubles."""
    place = (F.size(sorted_values) - 1) * F.lit(float(q))
    low = F.floor(place).cast("int")
    above = F.element_at(sorted_values, F.least(low + 1, F.size(sorted_values) - 1) + 1)
    part = place - low
    return F.when(part == 0, F.element_at(sorted_values, low + 1)).otherwise(
        (F.lit(1.0) - part) * F.element_at(sorted_values, low + 1) + part * above)


def interval_width(quantiles: tuple[float, ...] = vocab.QUANTILES) -> float:
    """A model's stated confidence: the share between its outer quantiles."""
    return round(float(quantiles[-1]) - float(quantiles[0]), 4)


def baseline_quantiles(monthly: DataFrame, horizon: int = vocab.DEFAULT_FORECAST_HORIZON,
                       quantiles: tuple[float, ...] = vocab.QUANTILES,
                       context: int = vocab.CONTEXT_LENGTH) -> DataFrame:
    """Native stand-in model: quantiles of the context tail, flat over the horizon.

    Output: product_id, step, period, demand (median), lower, upper, rounded to
    2 places, confidence, plus last_period of the history.
    """
    tail = context_points(monthly, context)
    q = tail.groupBy("product_id").agg(
        F.percentile(F.col("demand").cast("double"), F.array(*[F.lit(x) for x in quantiles])).alias("_q"),
        F.max("period").alias("last_period"),
    )
    rows = q.select("product_id", "last_period", F.lit(horizon).alias("horizon"),
                    F.array(F.col("_q")[0], F.col("_q")[len(quantiles) // 2], F.col("_q")[len(quantiles) - 1]).alias("_q"),
                    F.lit(interval_width(quantiles)).alias("confidence"))
    return _steps(rows.withColumn("_all", F.array_repeat("_q", F.col("horizon"))))


def _steps(rows: DataFrame) -> DataFrame:
    """One row per step from ``_all`` (per step: lower, middle, upper): periods and
    rounding are made here, for every model alike."""
    # periods are zipped in before the generator, so they are made once a row and not once a step
    steps = F.arrays_zip(S.next_periods(F.col("last_period"), F.col("horizon")).alias("period"), F.col("_all").alias("q"))
    made = rows.select("product_id", "last_period", "confidence", F.posexplode(steps).alias("_i", "_s"))
    return made.select(
        "product_id", (F.col("_i") + 1).alias("step"), F.col("_s.period").alias("period"),
        S.round_half_even(F.col("_s.q")[1], 2).alias("demand"), S.round_half_even(F.col("_s.q")[0], 2).alias("lower"),
        S.round_half_even(F.col("_s.q")[2], 2).alias("upper"), "confidence", "last_period")


# --- pluggable scorer (Arrow batches) -------------------------------------------

# (series, lengths, horizon): series has shape (batch, context), the last ``lengths``
# points of a row are its history, oldest first; returns (batch, horizon, 3): lower, middle, upper.
Scorer = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


class BaselineScorer:
    """numpy twin of ``baseline_quantiles`` for a whole batch at once."""

    def __init__(self, quantiles: tuple[float, ...] = vocab.QUANTILES) -> None:
        self.quantiles = (quantiles[0], quantiles[len(quantiles) // 2], quantiles[-1])
        self.confidence = interval_width(quantiles)

    def __call__(self, series: np.ndarray, lengths: np.ndarray, horizon: int) -> np.ndarray:
        n, width = series.shape
        unused = np.arange(width)[None, :] < (width - lengths)[:, None]
        ordered = np.sort(np.where(unused, np.inf, series), axis=1)  # unused places go last
        rows = np.arange(n)
        out = np.empty((n, horizon, 3))
        for k, q in enumerate(self.quantiles):
            place = (lengths - 1) * q
            low = np.floor(place).astype(int)
            part = place - low
            below, above = ordered[rows, low], ordered[rows, np.minimum(low + 1, lengths - 1)]
            out[:, :, k] = np.where(part == 0, below, (1 - part) * below + part * above)[:, None]
        return out


def baseline_scorer() -> Scorer:
    return BaselineScorer()


_SCORERS: dict[str, Scorer] = {}


def _cached_scorer(factory: Callable[[], Scorer]) -> Scorer:
    """Build the scorer once per Python worker (workers are reused across
    tasks), keyed by the pickled factory so different models never mix."""
    import hashlib

    from pyspark import cloudpickle
    key = hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()
    if key not in _SCORERS:
        _SCORERS[key] = factory()
    return _SCORERS[key]


def _unscorable() -> Column:
    """Why a request cannot be scored; null where it can."""
    history = F.col("history")
    demand = F.transform(history, lambda p: p["demand"].cast("double"))
    bad = F.exists(demand, lambda d: d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")))
    return (F.when(F.col("product_id").isNull(), F.lit("productId is required"))
            .when(F.coalesce(F.size(history), F.lit(0)) <= 0, F.lit("history must be a non-empty array"))
            .when(bad, F.lit("demand must be a number in every period"))
            .when(~F.coalesce(F.col("horizon").cast("int").between(1, vocab.MAX_FORECAST_HORIZON), F.lit(False)),
                  F.lit(f"horizon must be between 1 and {vocab.MAX_FORECAST_HORIZON}")))


def unscorable(requests: DataFrame) -> DataFrame:
    """The requests that ``score_forecast`` leaves out, with ``error``: each fails alone."""
    return requests.withColumn("error", _unscorable()).filter(F.col("error").isNotNull())


def score_forecast(requests: DataFrame, scorer_factory: Callable[[], Scorer] = baseline_scorer,
                   context: int = vocab.CONTEXT_LENGTH) -> DataFrame:
    """Score (product_id, history array<struct<period,demand>>, horizon) rows.

    The history is cut to the context on the JVM side; the scorer, built by
    ``scorer_factory`` once per Python worker, gets each Arrow batch as one matrix
    and gives numbers only (and its ``confidence``, if it states one).  Periods,
    rounding and one row per step are made on the JVM side.  Requests that cannot be
    scored (no history, a missing demand, a horizon out of range) give no rows and
    stop nothing; ``unscorable`` lists them.
    """
    from tidemark.session import ship_package
    ship_package(requests.sparkSession)  # the scorer runs in executors' Python workers
    prepared = requests.filter(_unscorable().isNull()).select(
        "product_id", F.col("horizon").cast("int").alias("horizon"),
        S.context_tail(F.col("history"), context).alias("tail"),
        F.try_element_at(F.col("history"), F.lit(-1))["period"].alias("last_period"),
    ).select("product_id", "horizon", "last_period", F.col("tail.demand").cast("array<double>").alias("series"))

    def run(batches):
        scorer = _cached_scorer(scorer_factory)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            lists = batch.column("series")
            lengths = np.diff(lists.offsets.to_numpy()).astype(int)
            width = max(int(lengths.max()), 1)
            series = np.full((n, width), np.nan)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            series[np.repeat(np.arange(n), lengths), np.repeat(width - lengths, lengths) + at] = flat
            horizons = batch.column("horizon").to_numpy()
            made = np.asarray(scorer(series, lengths, int(horizons.max())), dtype=float)
            steps = [pred[:h].tolist() for pred, h in zip(made, horizons.tolist())]
            confidence = getattr(scorer, "confidence", None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("product_id"), batch.column("horizon"), batch.column("last_period"),
                 pa.array(steps, pa.list_(pa.list_(pa.float64()))), pa.array([confidence] * n, pa.float64())],
                ["product_id", "horizon", "last_period", "_all", "confidence"])

    return _steps(prepared.mapInArrow(run, "product_id string, horizon int, last_period string, "
                                           "_all array<array<double>>, confidence double"))


def forecast_record(preds: DataFrame, as_of: dt.datetime | Column,
                    model_version: str = vocab.DEFAULT_MODEL_VERSION) -> DataFrame:
    """Long predictions -> one forecast record per product (status active).

    ``as_of`` is when the record is made.  The id is a hash of product, ``as_of`` and
    model version: a re-run gives the same record, the next run another one.
    Confidence and accuracy are the model's own (null where it states none).
    """
    created = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    stated = {c: (F.max(c) if c in preds.columns else F.lit(None).cast("double")).alias(c) for c in ("confidence", "accuracy")}
    g = preds.groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.struct("step", "period", "demand", "lower", "upper"))).alias("_p"), *stated.values())
    return g.select(
        S.stable_id("fc-", "product_id", created, F.lit(model_version)).alias("forecast_id"),
        "product_id",
        F.transform(F.col("_p"), lambda x: F.struct(x["period"].alias("period"), x["demand"].alias("demand"),
                                                    x["lower"].alias("lower"), x["upper"].alias("upper"))
                    ).alias("predictions"),
        "confidence",
        "accuracy",
        F.lit(model_version).alias("model_version"),
        F.lit("active").alias("status"),
        created.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def explode_predictions(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("forecast_id", "product_id", "created_at",
                            F.posexplode("predictions").alias("_i", "p")) \
                    .select("forecast_id", "product_id", "created_at", (F.col("_i") + 1).alias("step"),
                            F.col("p.period").alias("period"), F.col("p.demand").alias("demand"),
                            F.col("p.lower").alias("lower"), F.col("p.upper").alias("upper"))


def _accuracy(actual: Column, predicted: Column) -> Column:
    return F.when(actual.isNotNull() & (predicted != 0), S.round_exact(actual * 100 / predicted, 1, "up"))


def forecast_vs_actual(forecasts: DataFrame, monthly: DataFrame) -> DataFrame:
    """Predicted vs actual demand per (product, period); accuracy =
    round(100 * actual / predicted, 1), null when there is no actual."""
    p = explode_predictions(forecasts)
    a = monthly.select("product_id", "period", F.col("demand").cast("double").alias("actual"))
    j = p.join(a, ["product_id", "period"], "left")
    return j.select("forecast_id", "product_id", "period", "step", "demand", "actual",
                    _accuracy(F.col("actual"), F.col("demand")).alias("accuracy"))


def backtest(monthly: DataFrame, cutoff: str, horizon: int = vocab.DEFAULT_FORECAST_HORIZON,
             quantiles: tuple[float, ...] = vocab.QUANTILES, context: int = vocab.CONTEXT_LENGTH) -> DataFrame:
    """Baseline forecasts from the months before ``cutoff`` against the actual
    demand of the months they are for: product_id, period, step, demand, actual, accuracy.

    One grouped row per product holds its months (bounded by their number); the
    context, the quantiles and the actuals all come from that row, so the demand
    history is aggregated and shuffled once.
    """
    months = F.transform("history", lambda x: x["period"])
    known = collect_history(monthly).withColumn("_past", F.filter("history", lambda x: x["period"] < cutoff))
    known = known.filter(F.size("_past") > 0).withColumn("_tail", S.context_tail(F.col("_past"), context))
    values = F.array_sort(F.transform("_tail", lambda x: x["demand"]))
    made = known.withColumn("_sorted", values).select(
        "product_id", months.alias("_months"), F.transform("history", lambda x: x["demand"]).alias("_demands"),
        S.round_half_even(array_quantile(F.col("_sorted"), quantiles[len(quantiles) // 2]), 2).alias("demand"),
        F.posexplode(S.next_periods(F.element_at("_past", -1)["period"], horizon)).alias("_i", "period"))
    found = F.array_position("_months", F.col("period"))
    actual = F.when(found > 0, F.element_at("_demands", F.greatest(found, F.lit(1)).cast("int")))
    made = made.select("product_id", "period", (F.col("_i") + 1).alias("step"), "demand", actual.alias("actual"))
    return made.withColumn("accuracy", _accuracy(F.col("actual"), F.col("demand")))


def latest_forecast(forecasts: DataFrame) -> DataFrame:
    """Newest forecast (created_at desc, then id) as chart rows (trap T9)."""
    top = forecasts.orderBy(F.col("created_at").desc_nulls_last(), F.col("forecast_id").desc()).limit(1)
    return explode_predictions(top)
