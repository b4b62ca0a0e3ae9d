"""Alert derivation: alarm events -> alerts -> critical notifications; alert creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import vocab
from tidemark.functions import scalars as S
from tidemark.operators import validate as V


def alarm_to_alert(events: DataFrame) -> DataFrame:
    """ALARM-state events -> alert rows (type, category, title, message, metadata).

    ``events`` carries id, event_time, alarm_name, state, reason, region and account.
    The alert's id is made of the event's, so a re-run writes the same ids.
    """
    ev = events.filter(F.coalesce(F.col("state") == vocab.ALARM_STATE, F.lit(False)))
    name = F.coalesce(F.col("alarm_name"), F.lit(vocab.DEFAULT_ALARM_NAME))
    return ev.select(
        F.concat(F.lit("al-"), F.col("id")).alias("alert_id"),
        S.classify_severity(name).alias("alert_type"),
        S.classify_category(name).alias("category"),
        F.concat(F.lit(vocab.ALARM_TITLE_PREFIX), name).alias("title"),
        F.coalesce(F.col("reason"), F.lit(vocab.ALARM_DEFAULT_REASON)).alias("message"),
        F.col("event_time").alias("ts"),
        F.lit(vocab.ALARM_SOURCE_LABEL).alias("source"),
        F.lit(False).alias("acknowledged"),
        F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"),
        F.lit(True).alias("action_required"),
        F.create_map(F.lit("alarmName"), name,
                     F.lit("region"), F.coalesce(F.col("region"), F.lit("")),
                     F.lit("accountId"), F.coalesce(F.col("account"), F.lit(""))).alias("metadata"),
    )


def alert_defaults(requests: DataFrame) -> DataFrame:
    """Create-alert requests -> alert rows with defaults and a status code.

    title is required (null, "" missing); type must be info/warning/critical
    (default info).  Rejected requests keep status_code 400 and an error.  The alert
    has the columns of one that comes from an alarm, the request's ``metadata``
    (empty when it has none) included.
    """
    metadata = F.col("metadata") if "metadata" in requests.columns else F.lit(None).cast("map<string,string>")
    missing = V.missing_fields(["title"])
    atype = F.coalesce(F.col("alert_type"), F.lit(vocab.DEFAULT_ALERT_TYPE))
    type_ok = atype.isin(*vocab.ALERT_TYPES)
    status = (F.when(F.size(missing) > 0, F.lit(400)).when(~type_ok, F.lit(400)).otherwise(F.lit(201)))
    error = (F.when(F.size(missing) > 0, F.concat(F.lit("Missing required field(s): "), F.array_join(missing, ", ")))
             .when(~type_ok, F.lit("type must be one of: " + ", ".join(vocab.ALERT_TYPES))))
    return requests.select(
        "request_id",
        status.alias("status_code"),
        error.alias("error"),
        F.when(status == 201, S.stable_id("al-", F.col("request_id"))).alias("alert_id"),
        atype.alias("alert_type"),
        F.coalesce(F.col("category"), F.lit(vocab.DEFAULT_CATEGORY)).alias("category"),
        F.col("title"),
        F.coalesce(F.col("message"), F.lit("")).alias("message"),
        F.col("requested_at").cast("timestamp_ntz").alias("ts"),
        F.coalesce(F.col("source"), F.lit(vocab.DEFAULT_ALERT_SOURCE)).alias("source"),
        F.lit(False).alias("acknowledged"),
        F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"),
        F.coalesce(F.col("action_required"), F.lit(False)).alias("action_required"),
        F.coalesce(metadata, F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def notify_payload(alerts: DataFrame, subject_prefix: str = "Critical Alert: ") -> DataFrame:
    """Critical alerts -> notification rows (subject <= 100 chars, JSON body)."""
    crit = alerts.filter(F.col("alert_type") == "critical")
    body = S.json_object_text(("title", F.col("title")), ("message", F.col("message")),
                              ("category", F.col("category")), ("timestamp", S.iso_utc(F.col("ts"))))
    return crit.select("alert_id", S.notify_subject(F.col("title"), subject_prefix).alias("subject"),
                       body.alias("body"), "ts")


def critical_fanout(alerts: DataFrame, subject_prefix: str = "Critical Alert: ") -> tuple[DataFrame, DataFrame]:
    """The same alert rows feed the alerts table and, if critical, notifications."""
    return alerts, notify_payload(alerts, subject_prefix)
