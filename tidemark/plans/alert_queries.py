"""Alert queries: event intake, classification, defaults, notifications, sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars as S
from tidemark.operators import alerts as A
from tidemark.operators import validate as Val
from tidemark.plans import views as V
from tidemark.plans.alarm_path import alerts_from_metrics
from tidemark.plans.oracle_views import category_sql, iso_sql, q, severity_sql, stable_id_sql
from tidemark.plans.registry import register
from tidemark.session import scratch_path
from tidemark.sources import events as E
from tidemark.sources import files

SUBJECT_PREFIX = "Critical Alert: "
INTAKE_TIME = dt.datetime(2024, 12, 31)      # for events without a time, where the landing files have none
DEAD_LETTERS_AS_OF = dt.datetime(2024, 1, 25)

_ALERT_COLS = ("alert_id, alert_type, category, title, message, source, action_required, "
               "meta_alarm_name, meta_region, meta_account_id")


def _flat_alert(df):
    return df.select("alert_id", "alert_type", "category", "title", "message", "source", "action_required",
                     F.col("metadata")["alarmName"].alias("meta_alarm_name"),
                     F.col("metadata")["region"].alias("meta_region"),
                     F.col("metadata")["accountId"].alias("meta_account_id"))


def _parsed(spark, sf):
    good, _ = E.parse_alarm_events(V.alarm_events(spark, sf))
    return good


_ACCEPTED = (f"parse_ok AND source = {q(vocab.ALARM_EVENT_SOURCE)} "
             f"AND detail_type = {q(vocab.ALARM_EVENT_DETAIL_TYPE)}")

_NOTIFY_SQL = f"""
SELECT alert_id, substr({q(SUBJECT_PREFIX)} || title, 1, {vocab.NOTIFY_SUBJECT_MAX}) AS subject,
       '{{"title": ' || to_json(title) || ', "message": ' || to_json(message) || ', "category": ' || to_json(category)
       || ', "timestamp": ' || to_json({iso_sql('ts')}) || '}}' AS body
FROM alerts WHERE alert_type = 'critical'"""


@register("source_alarm_events", f"""
SELECT id, alarm_name, state, reason, region, account, CASE WHEN has_time THEN event_time END AS event_time
FROM alarm_keyed WHERE {_ACCEPTED}""", ("alarm_keyed",))
def source_alarm_events(spark, sf):
    path = scratch_path(spark, "alarm_events_json")
    files.sink_text(V.alarm_events(spark, sf).select("payload"), path)
    intake = F.lit(INTAKE_TIME)
    good, _ = E.parse_alarm_events(E.read_alarm_events_json(spark, path).withColumn("received_at", intake))
    return E.accept_alarm_events(good).select("id", "alarm_name", "state", "reason", "region", "account",
                                              F.nullif("event_time", intake.cast("timestamp_ntz")).alias("event_time"))


@register("parse_event_json", """
SELECT event_id, json_ok AS parse_ok, CASE WHEN json_ok THEN alarm_name END AS alarm_name,
       CASE WHEN json_ok THEN state END AS state FROM alarm_flat""", ("alarm_flat",))
def parse_event_json(spark, sf):
    p = E.parse_event_json(V.alarm_events(spark, sf))
    return p.select("event_id", "parse_ok", F.col("event.detail.alarmName").alias("alarm_name"),
                    F.col("event.detail.state.value").alias("state"))


@register("sink_dead_letter", f"""
SELECT event_id, ts, ts + INTERVAL 14 DAY AS expires_at,
       CASE WHEN json_ok THEN {q(E.BAD_TIME)} ELSE {q(E.BAD_PAYLOAD)} END AS error
FROM alarm_flat WHERE NOT parse_ok AND ts + INTERVAL 14 DAY > TIMESTAMP '{DEAD_LETTERS_AS_OF:%Y-%m-%d %H:%M:%S}'""",
          ("alarm_flat",))
def sink_dead_letter(spark, sf):
    """Dead letters that are still within their retention."""
    _, dead = E.parse_alarm_events(V.alarm_events(spark, sf))
    path = scratch_path(spark, "dead_letter")
    files.sink_run(E.dead_letters(dead, as_of=DEAD_LETTERS_AS_OF), path, "batch-1")
    return files.read_runs(spark, path).select("event_id", "ts", "expires_at", "error")


@register("filter_alarm_state", f"""
SELECT event_id, alarm_name, state FROM alarm_flat WHERE {_ACCEPTED} AND state = 'ALARM'""", ("alarm_flat",))
def filter_alarm_state(spark, sf):
    return E.filter_alarm_state(E.accept_alarm_events(_parsed(spark, sf))).select("event_id", "alarm_name", "state")


@register("classify_category", f"SELECT event_id, {category_sql('alarm_name')} AS category FROM alarm_flat",
          ("alarm_flat",))
def classify_category(spark, sf):
    f = V.alarm_events_flat(spark, sf)
    return f.select("event_id", S.classify_category("alarm_name").alias("category"))


@register("classify_severity", f"SELECT event_id, {severity_sql('alarm_name')} AS severity FROM alarm_flat",
          ("alarm_flat",))
def classify_severity(spark, sf):
    f = V.alarm_events_flat(spark, sf)
    return f.select("event_id", S.classify_severity("alarm_name").alias("severity"))


@register("alarm_to_alert", f"SELECT {_ALERT_COLS} FROM alerts", ("alerts",))
def alarm_to_alert(spark, sf):
    ev = E.accept_alarm_events(_parsed(spark, sf))
    return _flat_alert(A.alarm_to_alert(ev))


@register("notify_payload", _NOTIFY_SQL, ("alerts",))
def notify_payload(spark, sf):
    return A.notify_payload(V.alerts(spark, sf), SUBJECT_PREFIX).select("alert_id", "subject", "body")


@register("sink_notify_critical", _NOTIFY_SQL, ("alerts",))
def sink_notify_critical(spark, sf):
    _, notes = A.critical_fanout(V.alerts(spark, sf), SUBJECT_PREFIX)
    path = scratch_path(spark, "notifications")
    files.sink_run(notes, path, "batch-1")
    return files.read_runs(spark, path).select("alert_id", "subject", "body")


_DEFAULTS_SQL = f"""
SELECT request_id,
       CASE WHEN title IS NULL OR title = '' THEN 400
            WHEN COALESCE(alert_type, 'info') NOT IN ('info', 'warning', 'critical') THEN 400 ELSE 201 END AS status_code,
       COALESCE(alert_type, 'info') AS alert_type, COALESCE(category, 'system') AS category,
       COALESCE(message, '') AS message, COALESCE(source, 'System') AS source,
       COALESCE(action_required, FALSE) AS action_required,
       CASE WHEN title IS NULL OR title = '' THEN 'Missing required field(s): title'
            WHEN COALESCE(alert_type, 'info') NOT IN ('info', 'warning', 'critical')
            THEN 'type must be one of: info, warning, critical' END AS error,
       {stable_id_sql('al-', 'request_id')} AS alert_id, title, meta_origin, requested_at
FROM alert_create_requests"""


@register("alert_defaults", f"""
SELECT request_id, status_code, alert_type, category, message, source, action_required, meta_origin, error
FROM ({_DEFAULTS_SQL}) t""", ("alert_create_requests",))
def alert_defaults(spark, sf):
    return A.alert_defaults(V.alert_create_requests(spark, sf)).select(
        "request_id", "status_code", "alert_type", "category", "message", "source", "action_required",
        F.col("metadata")["origin"].alias("meta_origin"), "error")


@register("new_ids", f"SELECT request_id, alert_id FROM ({_DEFAULTS_SQL}) t WHERE status_code = 201",
          ("alert_create_requests",))
def new_ids(spark, sf):
    d = A.alert_defaults(V.alert_create_requests(spark, sf))
    return d.filter(F.col("status_code") == 201).select("request_id", "alert_id")


@register("sink_put", f"""
SELECT alert_id, alert_type, category, title, message, source, action_required, requested_at AS ts, meta_origin
FROM ({_DEFAULTS_SQL}) t WHERE status_code = 201""", ("alert_create_requests",))
def sink_put(spark, sf):
    accepted = A.alert_defaults(V.alert_create_requests(spark, sf)).filter(F.col("status_code") == 201) \
                .drop("status_code", "error", "request_id")
    path = scratch_path(spark, "alerts_table")
    files.sink_run(accepted, path, "batch-1")
    return files.read_runs(spark, path).select("alert_id", "alert_type", "category", "title", "message", "source",
                                               "action_required", "ts", F.col("metadata")["origin"].alias("meta_origin"))


@register("validate_required", """
SELECT request_id,
       array_to_string(list_filter([CASE WHEN title IS NULL OR title = '' THEN 'title' END,
                                    CASE WHEN message IS NULL OR message = '' THEN 'message' END],
                                   lambda x: x IS NOT NULL), ', ') AS missing,
       CASE WHEN title IS NULL OR title = '' OR message IS NULL OR message = '' THEN 400 ELSE 200 END AS status_code
FROM alert_create_requests""", ("alert_create_requests",))
def validate_required(spark, sf):
    r = Val.validate_required(V.alert_create_requests(spark, sf), ["title", "message"])
    return r.select("request_id", "missing", "status_code")


@register("alarm_path", f"""
SELECT 'al-' || {stable_id_sql('', "(alarm || '|' || strftime(changed_at, '%Y-%m-%d %H:%M:%S'))")} AS alert_id,
       {severity_sql('alarm')} AS alert_type, {category_sql('alarm')} AS category,
       {q(vocab.ALARM_TITLE_PREFIX)} || alarm AS title,
       'Threshold Crossed: ' || statistic || ' ' || comparison || ' ' || CAST(threshold AS VARCHAR) || ' for '
         || CAST(periods AS VARCHAR) || ' period(s)' AS message, changed_at AS ts
FROM (SELECT c.alarm, c.period_start AS changed_at, r.statistic, r.comparison, r.threshold, r.periods,
             lag(c.period_start) OVER (PARTITION BY c.alarm ORDER BY c.period_start) AS prev
      FROM consecutive c JOIN alarm_rules r ON c.alarm = r.alarm WHERE in_alarm) a
WHERE prev IS NULL OR prev <> changed_at - to_seconds({vocab.ALARM_PERIOD_SECONDS})""", ("consecutive", "alarm_rules"))
def alarm_path(spark, sf):
    """The event path as one job: metrics -> alarms -> state changes -> alerts."""
    found, _ = alerts_from_metrics(spark, V.metrics(spark, sf))
    return found.select("alert_id", "alert_type", "category", "title", "message", "ts")
