"""Alert intake and creation: the reference's own alert-service cases."""

import json

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import alerts as A
from tidemark.operators import records as R
from tidemark.operators import updates as U
from tidemark.sources import events as E


def alarm_payload(name, state="ALARM", reason="threshold breached", eid="1"):
    return json.dumps({"id": eid, "source": "aws.cloudwatch", "detail-type": "CloudWatch Alarm State Change",
                       "region": "us-east-1", "account": "123456789012", "time": "2026-01-01T00:00:00",
                       "detail": {"alarmName": name, "state": {"value": state, "reason": reason}}})


def intake(spark, payloads):
    raw = spark.createDataFrame([(p,) for p in payloads], "payload string")
    good, dead = E.parse_alarm_events(raw)
    alerts = A.alarm_to_alert(E.accept_alarm_events(good))
    _, notes = A.critical_fanout(alerts)
    return alerts, notes, dead


def test_category_classification_five_names(spark):
    cases = {
        "low-stock-warehouse-7": "inventory",
        "demand-forecast-drift": "demand",
        "supplier-sla-breach": "supply",
        "unauthorized-access-attempt": "security",
        "cpu-high": "system",
    }
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r.name: r.c for r in df.select("name", S.classify_category("name").alias("c")).collect()}
    assert got == cases


def test_critical_alarm_creates_alert_and_notification(spark):
    alerts, notes, _ = intake(spark, [alarm_payload("critical-inventory-stockout")])
    rows = alerts.collect()
    assert len(rows) == 1
    a = rows[0]
    assert (a.alert_type, a.category, a.action_required) == ("critical", "inventory", True)
    assert a.title == "CloudWatch Alarm: critical-inventory-stockout"
    assert a.metadata["alarmName"] == "critical-inventory-stockout" and a.metadata["accountId"] == "123456789012"
    n = notes.collect()
    assert len(n) == 1 and len(n[0].subject) <= 100
    assert json.loads(n[0].body)["category"] == "inventory"


def test_non_critical_alarm_skips_notification(spark):
    alerts, notes, _ = intake(spark, [alarm_payload("demand-forecast-drift")])
    assert [r.alert_type for r in alerts.collect()] == ["warning"]
    assert notes.count() == 0


def test_ok_state_ignored_and_bad_json_dead_lettered(spark):
    alerts, _, dead = intake(spark, [alarm_payload("critical-x", state="OK"), "{not json", "[1, 2]"])
    assert alerts.count() == 0
    assert sorted(r.payload for r in dead.collect()) == sorted(["{not json", "[1, 2]"])


def test_events_as_the_bus_delivers_them(spark):
    """Text ids, missing ids and times, and times that cannot be read: nothing is lost."""
    import datetime as dt
    fixture = json.dumps({"source": "aws.cloudwatch", "detail-type": "CloudWatch Alarm State Change", "region": "us-east-1",
                          "account": "123", "detail": {"alarmName": "critical-a", "state": {"value": "ALARM", "reason": "r"}}})
    uuid = alarm_payload("critical-b", eid="7f3c2a44-9a1d-4c55-8f6b-2f1f6f1f0a11")
    zoned = alarm_payload("c", eid="z").replace("2026-01-01T00:00:00", "2026-01-01T02:00:00+02:00")
    bad_time = alarm_payload("critical-d").replace("2026-01-01T00:00:00", "yesterday")
    raw = spark.createDataFrame([(p, dt.datetime(2026, 5, 1)) for p in (fixture, uuid, zoned, bad_time)],
                                "payload string, received_at timestamp_ntz")
    good, dead = E.parse_alarm_events(raw)
    alerts = {r.title: r for r in A.alarm_to_alert(E.accept_alarm_events(good)).collect()}
    assert len(alerts) == 3
    one = alerts["CloudWatch Alarm: critical-a"]
    assert one.ts == dt.datetime(2026, 5, 1) and one.alert_id.startswith("al-ev-")
    assert alerts["CloudWatch Alarm: critical-b"].alert_id == "al-7f3c2a44-9a1d-4c55-8f6b-2f1f6f1f0a11"
    assert alerts["CloudWatch Alarm: c"].ts == dt.datetime(2026, 1, 1)
    assert [(r.payload, r.error) for r in dead.collect()] == [(bad_time, E.BAD_TIME)]
    again = A.alarm_to_alert(E.accept_alarm_events(E.parse_alarm_events(raw)[0]))
    assert sorted(r.alert_id for r in again.collect()) == sorted(a.alert_id for a in alerts.values())


def test_body_keeps_line_separators(spark):
    alerts, notes, _ = intake(spark, [alarm_payload("critical-x", reason="a\u2028b\u0085c\nd")])
    assert json.loads(notes.first().body)["message"] == "a\u2028b\u0085c\nd"


def test_created_alert_has_the_schema_of_an_alarm_alert(spark):
    req = spark.sql("select 'r1' request_id, 't' title, string(null) alert_type, string(null) category, string(null) message, "
                    "string(null) source, boolean(null) action_required, map('k', 'v') metadata, "
                    "timestamp_ntz'2026-01-01 00:00:00' requested_at")
    made = A.alert_defaults(req).drop("request_id", "status_code", "error")
    alarm, _, _ = intake(spark, [alarm_payload("x")])
    assert dict(made.dtypes) == dict(alarm.dtypes)
    assert made.first().metadata == {"k": "v"}
    assert A.alert_defaults(req.withColumn("metadata", F.lit(None).cast("map<string,string>"))).first().metadata == {}


def test_long_title_subject_is_cut(spark):
    _, notes, _ = intake(spark, [alarm_payload("critical-" + "x" * 200)])
    assert len(notes.collect()[0].subject) == 100


def test_create_alert_requires_title_and_valid_type(spark):
    req = spark.createDataFrame(
        [("r1", None, None, None, "x", None, None, None), ("r2", "t", "panic", None, None, None, None, None),
         ("r3", "t", None, None, None, None, True, None)],
        "request_id string, title string, alert_type string, category string, message string, source string, "
        "action_required boolean, requested_at timestamp_ntz")
    out = {r.request_id: r for r in A.alert_defaults(req).collect()}
    assert out["r1"].status_code == 400 and out["r1"].error == "Missing required field(s): title"
    assert out["r2"].status_code == 400
    r3 = out["r3"]
    assert (r3.status_code, r3.alert_type, r3.category, r3.message, r3.source, r3.action_required) == \
        (201, "info", "system", "", "System", True)
    assert r3.alert_id.startswith("al-")


def test_sort_newest_first_and_unacknowledged(spark):
    df = spark.createDataFrame([("a1", "2026-01-01", True), ("a2", "2026-03-01", False), ("a3", "2026-02-01", False)],
                               "alert_id string, ts string, acknowledged boolean")
    assert [r.alert_id for r in R.sort_newest_first(df, "ts", "alert_id").collect()] == ["a2", "a3", "a1"]
    assert R.alerts_unacknowledged_count(df).collect()[0].unacknowledged == 2
    with_null = df.union(spark.createDataFrame([("a4", "2026-04-01", None)], df.schema))
    assert R.alerts_unacknowledged_count(with_null).collect()[0].unacknowledged == 3


def test_acknowledge_missing_is_not_found_and_existing_is_updated(spark):
    inv = spark.createDataFrame([("ia-1", False, None)], "alert_id string, acknowledged boolean, acknowledged_at timestamp_ntz")
    req = spark.sql("select 'ia-1' as alert_id, timestamp_ntz'2026-01-01 00:00:00' as requested_at "
                    "union all select 'a-missing', timestamp_ntz'2026-01-01 00:00:00'")
    snap = U.acknowledge(inv, req).collect()
    assert len(snap) == 1 and snap[0].acknowledged is True and snap[0].acknowledged_at is not None
    assert [r.alert_id for r in U.update_not_found(inv, req, "alert_id").collect()] == ["a-missing"]


def test_notification_body_uses_json_dumps_format(spark):
    alerts, notes, _ = intake(spark, [alarm_payload("critical-inventory-stockout", reason='a "b" \\ c')])
    a, n = alerts.collect()[0], notes.collect()[0]
    expect = json.dumps({"title": a.title, "message": a.message, "category": a.category,
                         "timestamp": a.ts.strftime("%Y-%m-%dT%H:%M:%S")})
    assert n.body == expect


# Fixed expectations of FIXTURES B.1: (rule suffix, category by the keyword rule, severity)
B1 = [("critical-forecasts-errors", "demand", "critical"), ("critical-alerts-errors", "system", "critical"),
      ("data-platform-errors", "system", "warning"), ("optimization-errors", "system", "warning"),
      ("analytics-errors", "system", "warning"), ("critical-governance-errors", "system", "critical"),
      ("critical-dlq-depth", "system", "critical"), ("critical-api-5xx", "system", "critical"),
      ("api-latency-p99", "system", "warning")]


def test_rule_alarm_names_classify_as_fixture_b1(spark):
    from tidemark import vocab
    assert [r[0] for r in vocab.ALARM_RULES] == [b[0] for b in B1]
    df = spark.createDataFrame([(n,) for n, _, _ in B1], "name string")
    got = [(r.name, r.c, r.s) for r in df.select("name", S.classify_category("name").alias("c"),
                                                  S.classify_severity("name").alias("s")).collect()]
    assert got == B1


def test_alarm_path_metrics_to_alerts(spark):
    import datetime as dt
    from tidemark.plans.alarm_path import alerts_from_metrics
    t0 = dt.datetime(2026, 1, 1)
    rows = [("Latency:api", t0 + dt.timedelta(seconds=300 * p + 10), "Latency", "api", v)
            for p, v in [(0, 3500.0), (1, 3600.0), (2, 3700.0), (3, 10.0), (4, 10.0)]]
    rows += [("Errors:forecasts", t0 + dt.timedelta(seconds=30), "Errors", "forecasts", 2.0)]
    m = spark.createDataFrame(rows, "metric_id string, ts timestamp_ntz, name string, dim_value string, value double")
    alerts, notes = alerts_from_metrics(spark, m)
    got = sorted((r.title, r.alert_type, r.category) for r in alerts.collect())
    assert got == [("CloudWatch Alarm: api-latency-p99", "warning", "system"),
                   ("CloudWatch Alarm: critical-forecasts-errors", "critical", "demand")]
    assert [r.subject for r in notes.collect()] == ["Critical Alert: CloudWatch Alarm: critical-forecasts-errors"]
    again = sorted(r.alert_id for r in alerts_from_metrics(spark, m)[0].collect())
    assert again == sorted(r.alert_id for r in alerts.collect())  # re-runs give the same ids
