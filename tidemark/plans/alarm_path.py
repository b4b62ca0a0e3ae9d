"""The alarm event path as one batch plan:

metrics -> period stats -> rules -> N-consecutive -> ALARM/OK state changes
        -> state-change events -> accepted ALARM events -> alerts + notifications.

Every step is an operator of this package; the streaming twins live in
``tidemark.streaming.alarms``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import vocab
from tidemark.functions import scalars as S
from tidemark.operators import alerts as A
from tidemark.operators import metrics as M
from tidemark.sources import events as E


def alarm_state_events(transitions: DataFrame, rules: DataFrame, region: str = "",
                       account: str = "", name_prefix: str = "") -> DataFrame:
    """State changes -> alarm state-change events (flat form of the JSON event).

    The event id is a hash of (alarm, changed_at), so a re-run emits the same
    events; the reason states the rule that was crossed.
    """
    ev = transitions.join(rules.select("alarm", "statistic", "comparison", "threshold", "periods"), "alarm")
    reason = F.format_string("Threshold Crossed: %s %s %s for %d period(s)",
                             F.col("statistic"), F.col("comparison"), F.col("threshold").cast("string"), F.col("periods"))
    return ev.select(
        S.stable_id("", "alarm", "changed_at").alias("id"),
        F.col("changed_at").alias("event_time"),
        F.lit(vocab.ALARM_EVENT_SOURCE).alias("source"),
        F.lit(vocab.ALARM_EVENT_DETAIL_TYPE).alias("detail_type"),
        F.lit(region).alias("region"),
        F.lit(account).alias("account"),
        F.concat(F.lit(name_prefix), F.col("alarm")).alias("alarm_name"),
        F.col("state"),
        F.when(F.col("state") == vocab.ALARM_STATE, reason).otherwise(F.lit("Threshold no longer crossed")).alias("reason"),
    )


def alerts_from_metrics(spark: SparkSession, metrics: DataFrame, subject_prefix: str = "Critical Alert: ",
                        name_prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(alerts, critical notifications) raised by the metric alarms."""
    rules = M.alarm_rules(spark)
    consecutive = M.alarm_consecutive(M.evaluate_metrics(metrics, rules))
    transitions = M.alarm_transitions(consecutive, last=M.last_period(metrics))
    events = E.accept_alarm_events(alarm_state_events(transitions, rules, name_prefix=name_prefix))
    alerts = A.alarm_to_alert(events)  # only ALARM changes become alerts; OK changes are ignored
    return A.critical_fanout(alerts, subject_prefix)
