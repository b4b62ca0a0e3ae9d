"""Metric windows, threshold alarms, consecutive-period alarms, state transitions.

Window statistics come from value counts: points are first counted per (group,
period, value), a partial aggregate that splits a hot series over all tasks.
Percentiles are exact nearest ranks at every size.  They are found in two levels,
first the piece of the value scale that holds the rank, then the value in that
piece, so that the values of a group do not meet in one task.

Alarm evaluation runs on the per-period statistics, whose row count is bounded by
(alarms x periods), not by the raw data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from tidemark import vocab
from tidemark.functions import scalars as S

PIECES = 1024            # pieces of values per unit of their logarithm in which a rank is sought

RULE_SCHEMA = T.StructType([
    T.StructField("alarm", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("dim_value", T.StringType()),
    T.StructField("statistic", T.StringType()),
    T.StructField("comparison", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("periods", T.IntegerType()),
])


def alarm_rules(spark: SparkSession) -> DataFrame:
    """The nine alarm rules as a table."""
    return spark.createDataFrame(list(vocab.ALARM_RULES), RULE_SCHEMA)


SERIES = ("metric_id", "name", "dim_value")
RULED = ("name", "dim_value")  # what an alarm rule names: all points of the pair are one series


def _piece() -> F.Column:
    """The piece of the value scale that holds ``value``, in the order of values: pieces
    are a thousandth of the logarithm wide, the same for all groups.  Missing values,
    infinities and NaN (above all numbers) have pieces of their own."""
    value, edge = F.col("value").cast("double"), F.lit(1_000_000.0)  # no finite value reaches the edge
    place = F.greatest(F.least(F.floor(F.signum(value) * F.log1p(F.abs(value)) * PIECES).cast("double"), edge), -edge)
    return (F.when(value.isNull(), F.lit(-2_000_000)).when(F.isnan(value), F.lit(2_000_000))
             .when(F.abs(value) == float("inf"), F.when(value > 0, edge).otherwise(-edge).cast("int"))
             .otherwise(place.cast("int")))


def window_counts(metrics: DataFrame, period_seconds: int = vocab.ALARM_PERIOD_SECONDS,
                  group: tuple[str, ...] = SERIES, ts: str = "ts") -> DataFrame:
    """Points per (group, period, value) as (*group, w, value, n): what is kept of a
    finished period.  All statistics follow from it, also those of longer periods
    (``roll_up``), without the points."""
    w = F.window(F.col(ts), f"{period_seconds} seconds")
    return metrics.groupBy(*group, w.alias("w"), "value").agg(F.count(F.lit(1)).alias("n"))


def roll_up(counts: DataFrame, period_seconds: int, group: tuple[str, ...] = SERIES) -> DataFrame:
    """The counts of longer periods, each a whole number of the shorter ones."""
    w = F.window(F.col("w.start"), f"{period_seconds} seconds")
    return counts.groupBy(*group, w.alias("w"), "value").agg(F.sum("n").alias("n"))


def stats_of_counts(counts: DataFrame, group: tuple[str, ...] = SERIES) -> DataFrame:
    """Sum / max / avg / count / p50 / p99 per group and period of ``window_counts``.
    Points without a value count as samples and nothing else.

    Percentiles are nearest ranks.  Counts per piece of the value scale tell which
    piece holds a rank, and only the distinct values of that piece are ranked.  The
    group is one struct key, in which a missing dimension equals itself.
    """
    rows = counts.select(F.struct(*group, "w").alias("_k"), _piece().alias("_piece"), "value", "n").repartition("_k", "_piece")
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    pieces = rows.groupBy("_k", "_piece").agg(
        F.sum("n").alias("_samples"), F.coalesce(F.sum(known), F.lit(0)).alias("_n"),
        F.sum(F.col("value") * F.col("n")).alias("_sum"), F.max("value").alias("_max"))
    whole = Window.partitionBy("_k")
    upto, total = F.sum("_n").over(whole.orderBy("_piece")), F.sum("_n").over(whole)
    stats = F.struct(F.sum("_sum").over(whole).alias("sum"), F.max("_max").over(whole).alias("max"),
                     (F.sum("_sum").over(whole) / F.nullif(total, F.lit(0))).alias("avg"),
                     F.sum("_samples").over(whole).alias("samples"))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.col("_total") * q).alias("rank"))
                                for name, q in (("p50", 0.5), ("p99", 0.99))])).alias("_w")
    hit = pieces.select("_k", "_piece", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), total.alias("_total"),
                        stats.alias("_stats")).select("*", ranks)
    # a group without values has rank 0 in its only piece
    hit = hit.filter((F.col("_w.rank") <= F.col("_upto")) & ((F.col("_w.rank") > F.col("_before")) | (F.col("_total") == 0)))
    inside = rows.join(hit.drop("_upto", "_total"), ["_k", "_piece"])
    within = Window.partitionBy("_k", "_piece", "_w").orderBy("value")
    inside = inside.withColumn("_reached", F.col("_before") + F.sum("n").over(within) >= F.col("_w.rank"))
    ranked = [F.min(F.when((F.col("_w.name") == name) & F.col("_reached"), F.col("value"))).alias(name) for name in ("p50", "p99")]
    found = inside.groupBy("_k").agg(F.any_value("_stats").alias("_stats"), *ranked)
    return found.select(*[F.col(f"_k.{c}").alias(c) for c in group], F.col("_k.w.start").alias("period_start"),
                        F.col("_k.w.end").alias("period_end"), "_stats.*", "p50", "p99")


def window_stats(metrics: DataFrame, period_seconds: int = vocab.ALARM_PERIOD_SECONDS,
                 group: tuple[str, ...] = SERIES, ts: str = "ts") -> DataFrame:
    """``stats_of_counts`` of a metrics table."""
    return stats_of_counts(window_counts(metrics, period_seconds, group, ts), group)


def _stat(stat_col):
    return (F.when(stat_col == "sum", F.col("sum")).when(stat_col == "max", F.col("max"))
             .when(stat_col == "avg", F.col("avg")).when(stat_col == "p50", F.col("p50"))
             .when(stat_col == "p99", F.col("p99")))


def _breach(value):
    thr = F.col("threshold")
    found = (F.when(F.col("comparison") == ">=", value >= thr).when(F.col("comparison") == ">", value > thr)
              .when(F.col("comparison") == "<", value < thr).when(F.col("comparison") == "<=", value <= thr))
    return F.coalesce(found, F.lit(False))


def evaluate_rules(stats: DataFrame, rules: DataFrame) -> DataFrame:
    """Per (alarm, period): the rule's statistic and whether it breaches.  ``stats``
    has one row per period and (name, dim_value), see ``RULED``; a rule without a
    dim_value is for the points without one."""
    named = rules.select(F.col("name").alias("_name"), F.col("dim_value").alias("_dim"),
                         *[c for c in rules.columns if c not in RULED])
    j = stats.join(named, (F.col("name") == F.col("_name")) & F.col("dim_value").eqNullSafe(F.col("_dim")))
    value = _stat(F.col("statistic"))
    return j.select("alarm", "name", "dim_value", "statistic", "threshold", "periods",
                    "period_start", "period_end", value.alias("stat_value"), _breach(value).alias("breach"))


def evaluate_metrics(metrics: DataFrame, rules: DataFrame, period_seconds: int = vocab.ALARM_PERIOD_SECONDS) -> DataFrame:
    """``evaluate_rules`` on a metrics table: percentiles are ranked only for the series
    whose rules ask for one, all other statistics take one plain aggregate."""
    by_rank = F.col("statistic").isin("p50", "p99")
    series = rules.filter(by_rank).select(F.col("name").alias("_name"), F.col("dim_value").alias("_dim")).distinct()
    of_rank = (F.col("name") == F.col("_name")) & F.col("dim_value").eqNullSafe(F.col("_dim"))
    ranked = window_stats(metrics.join(series, of_rank, "left_semi"), period_seconds, RULED)
    plain = metrics.groupBy(*RULED, F.window("ts", f"{period_seconds} seconds").alias("w")).agg(
        F.sum("value").alias("sum"), F.max("value").alias("max"), F.avg("value").alias("avg"))
    plain = plain.select(*RULED, F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"),
                         "sum", "max", "avg", *[F.lit(None).cast("double").alias(c) for c in ("p50", "p99")])
    return evaluate_rules(plain, rules.filter(~by_rank)).unionByName(evaluate_rules(ranked, rules.filter(by_rank)))


def alarm_consecutive(evaluated: DataFrame, period_seconds: int = vocab.ALARM_PERIOD_SECONDS) -> DataFrame:
    """``in_alarm`` when the last N periods all breach, N being the rule's own.

    A run of breaches starts where the period before is absent (not breaching) or
    does not breach; its length up to a period is the distance from its start.  Two
    functions over one window, so one sort, whatever the rules' N.
    """
    rule = Window.partitionBy("alarm", *RULED).orderBy("_epoch")
    df = evaluated.withColumn("_epoch", F.unix_seconds(F.col("period_start").cast("timestamp")))
    follows = (F.lag("_epoch").over(rule) == F.col("_epoch") - period_seconds) & F.lag("breach").over(rule)
    starts = F.col("breach") & ~F.coalesce(follows, F.lit(False))
    df = df.withColumn("_start", F.when(starts, F.col("_epoch")))
    df = df.withColumn("_start", F.last("_start", ignorenulls=True).over(rule))
    length = (F.col("_epoch") - F.col("_start")) / period_seconds + 1
    in_alarm = F.col("breach") & (length >= F.col("periods"))
    return df.withColumn("in_alarm", F.coalesce(in_alarm, F.lit(False))).drop("_epoch", "_start")


def last_period(metrics: DataFrame, period_seconds: int = vocab.ALARM_PERIOD_SECONDS, ts: str = "ts"):
    """Start of the period holding the newest metric point of any series: the
    evaluation clock ("now").  A one-column max over the scan, used as an
    uncorrelated scalar subquery."""
    newest = metrics.agg(F.max(ts).alias("_m"))
    return newest.select(F.window("_m", f"{period_seconds} seconds")["start"]).scalar()


def alarm_transitions(consecutive: DataFrame, period_seconds: int = vocab.ALARM_PERIOD_SECONDS,
                      last=None) -> DataFrame:
    """State changes ALARM / OK per alarm from the sparse in-alarm periods.

    A run of in-alarm periods starts with an ALARM change; the period right
    after the run (data or not: missing is not breaching) is an OK change,
    emitted when it is not past ``last``, the last evaluated period (see
    ``last_period``; defaults to the newest period in ``consecutive``).
    """
    if last is None:
        last = consecutive.select(F.max("period_start")).scalar()
    hot = consecutive.filter(F.col("in_alarm")).select("alarm", "period_start")
    w = Window.partitionBy("alarm").orderBy("period_start")
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(period_seconds))
    now, after = F.col("period_start"), F.col("period_start") + step
    marked = (hot.withColumn("_prev", F.lag("period_start").over(w))
                 .withColumn("_next", F.lead("period_start").over(w)).withColumn("_last", last))
    starts = F.col("_prev").isNull() | (F.col("_prev") != now - step)
    ends = (F.col("_next").isNull() | (F.col("_next") != after)) & (after <= F.col("_last"))
    # both changes of a period come out of one pass
    changes = F.array_compact(F.array(
        F.when(starts, F.struct(now.alias("changed_at"), F.lit("ALARM").alias("state"))),
        F.when(ends, F.struct(after.alias("changed_at"), F.lit("OK").alias("state")))))
    return marked.select("alarm", F.inline(changes))


def threshold_alarm(metrics: DataFrame, spark: SparkSession) -> DataFrame:
    """Windowed stats -> rules -> breaching periods only."""
    return evaluate_metrics(metrics, alarm_rules(spark)).filter(F.col("breach"))


def metric_sum_by_dimension(metric_events: DataFrame) -> DataFrame:
    """Counters per namespace, name and dimensions text."""
    return metric_events.groupBy("namespace", "metric_name", "dimensions").agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("events"))


def dims_text(*pairs: tuple[str, object]) -> F.Column:
    """Canonical dimension text ``k=v;k=v`` in the given key order."""
    parts = []
    for k, v in pairs:
        col = v if isinstance(v, F.Column) else F.lit(v)
        parts.append(F.concat(F.lit(f"{k}="), col))
    return F.concat_ws(";", *parts) if parts else F.lit("")


def ingestion_stats(sources: DataFrame) -> DataFrame:
    """Dashboard totals: records, 5 % processed today, avg quality, health %."""
    agg = sources.agg(
        F.sum("records_processed").alias("total_records"),
        F.avg("data_quality").alias("_avgq"),
        F.count_if(F.col("status") == "active").alias("_active"),
        F.count(F.lit(1)).alias("_n"),
    )
    return agg.select(
        "total_records",
        F.floor(F.col("total_records") * vocab.PROCESSED_TODAY_SHARE).alias("processed_today"),
        S.js_round(F.col("_avgq"), 1).alias("data_quality_avg"),
        S.js_round(F.col("_active") / F.col("_n") * 100, 1).alias("pipeline_health"),
    )
