"""Guarded updates and record jobs as batch joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.operators import updates as U
from tidemark.operators import validate as Val
from tidemark.plans import stored, views as V
from tidemark.plans.oracle_views import iso_sql, nth_request_sql, q
from tidemark.plans.registry import register
from tidemark.session import scratch_path
from tidemark.sources import files

_KNOWN = "[" + ", ".join(q(p) for p in vocab.KNOWN_PERMISSIONS) + "]"


def _latest(table: str, key: str) -> str:
    return (f"(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY requested_at DESC NULLS LAST) AS rn "
            f"FROM {table}) x WHERE rn = 1)")


def _both(snapshot, outcomes):
    """New snapshot and outcomes in one frame, told apart by ``part``."""
    return (snapshot.withColumn("part", F.lit("snapshot"))
            .unionByName(outcomes.withColumn("part", F.lit("outcome")), allowMissingColumns=True))


@register("update_existing", f"""
SELECT i.alert_id, COALESCE(r.alert_id IS NOT NULL, FALSE) AS updated,
       CASE WHEN r.alert_id IS NOT NULL THEN TRUE ELSE i.acknowledged END AS acknowledged,
       r.requested_at AS acknowledged_at
FROM inventory_alerts i LEFT JOIN {_latest('inventory_ack_requests', 'alert_id')} r ON i.alert_id = r.alert_id""",
          ("inventory_alerts", "inventory_ack_requests"))
def update_existing(spark, sf):
    """The requests applied to the stored table: only rows that they name are written."""
    table = stored.changed_copy(spark, sf, "inventory_alerts", "alert_id", acknowledged_at=F.lit(None).cast("timestamp_ntz"))
    requests = V.inventory_ack_requests(spark, sf)
    table.apply("acks-1", requests, lambda rows: U.acknowledge(rows, requests))
    return table.read(mark="updated").select("alert_id", "updated", "acknowledged", "acknowledged_at")


@register("acknowledge_alerts", f"""
SELECT a.alert_id, CASE WHEN r.alert_id IS NOT NULL THEN TRUE ELSE a.acknowledged END AS acknowledged,
       CASE WHEN r.alert_id IS NOT NULL THEN r.requested_at ELSE a.acknowledged_at END AS acknowledged_at
FROM alerts a LEFT JOIN {_latest('alert_ack_requests', 'alert_id')} r ON a.alert_id = r.alert_id""",
          ("alerts", "alert_ack_requests"))
def acknowledge_alerts(spark, sf):
    table = stored.changed_copy(spark, sf, "alerts", "alert_id")
    requests = V.alert_ack_requests(spark, sf)
    table.apply("acks-1", requests, lambda rows: U.acknowledge(rows, requests))
    return table.read().select("alert_id", "acknowledged", "acknowledged_at")


@register("update_not_found", """
SELECT r.alert_id, r.requested_at FROM alert_ack_requests r
WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.alert_id = r.alert_id)""", ("alerts", "alert_ack_requests"))
def update_not_found(spark, sf):
    return U.update_not_found(V.alerts(spark, sf), V.alert_ack_requests(spark, sf), "alert_id") \
            .select("alert_id", "requested_at")


_APPLIED = f"""(SELECT r.* FROM {nth_request_sql('apply_requests', 'optimization_id')} r
  JOIN optimizations o ON r.optimization_id = o.optimization_id WHERE rn = 1 AND o.status = 'proposed')"""


@register("apply_if_proposed", f"""
SELECT 'outcome' AS part, r.optimization_id, r.request_id, r.requested_at,
       CASE WHEN w.request_id IS NOT NULL THEN 'applied' ELSE 'not_found_or_applied' END AS outcome,
       CASE WHEN w.request_id IS NOT NULL THEN 200 ELSE 404 END AS status_code,
       CAST(NULL AS VARCHAR) AS status, CAST(NULL AS TIMESTAMP) AS applied_at
FROM apply_requests r LEFT JOIN {_APPLIED} w ON r.request_id = w.request_id
UNION ALL
SELECT 'snapshot', o.optimization_id, NULL, NULL, NULL, NULL,
       CASE WHEN w.request_id IS NOT NULL THEN 'applied' ELSE o.status END,
       CASE WHEN w.request_id IS NOT NULL THEN w.requested_at ELSE o.applied_at END
FROM optimizations o LEFT JOIN {_APPLIED} w ON o.optimization_id = w.optimization_id""",
          ("apply_requests", "optimizations"))
def apply_if_proposed(spark, sf):
    snap, outcomes = U.apply_if_proposed(V.optimizations(spark, sf), V.apply_requests(spark, sf))
    return _both(snap.select("optimization_id", "status", "applied_at"),
                 outcomes.select("optimization_id", "request_id", "requested_at", "outcome", "status_code"))


_ACCEPTED_ACCESS = f"len(list_filter(permissions, lambda x: NOT list_contains({_KNOWN}, x))) = 0"

_AUDIT_SQL = f"""
SELECT 'access_control_change' AS audit, COALESCE(r.actor, 'anonymous') AS actor, r.user_id AS subject,
       array_to_string(list_sort(CASE WHEN r.rn = 1 THEN a.permissions ELSE b.permissions END), ',') AS before,
       array_to_string(list_sort(r.permissions), ',') AS after, r.requested_at AS at
FROM {nth_request_sql('access_requests', 'user_id', '', _ACCEPTED_ACCESS)} r JOIN access_controls a ON r.user_id = a.user_id
LEFT JOIN {nth_request_sql('access_requests', 'user_id', '', _ACCEPTED_ACCESS)} b ON r.user_id = b.user_id AND b.rn = r.rn - 1"""


def _audit_text(df):
    return df.select("audit", "actor", "subject", F.array_join("before", ",").alias("before"),
                     F.array_join("after", ",").alias("after"), "at")


@register("audit_before_after", _AUDIT_SQL, ("access_requests", "access_controls"))
def audit_before_after(spark, sf):
    _, _, audit = U.access_replace(V.access_controls(spark, sf), V.access_requests(spark, sf))
    return _audit_text(audit)


@register("sink_audit", _AUDIT_SQL, ("access_requests", "access_controls"))
def sink_audit(spark, sf):
    _, _, audit = U.access_replace(V.access_controls(spark, sf), V.access_requests(spark, sf))
    path = scratch_path(spark, "audit")
    files.sink_run(audit, path, "batch-1")
    return _audit_text(files.read_runs(spark, path))


@register("access_replace", f"""
SELECT 'outcome' AS part, r.user_id, r.request_id, r.requested_at,
       CASE WHEN len(u.unknown) > 0 THEN 400 WHEN a.user_id IS NULL THEN 404 ELSE 200 END AS status_code,
       CASE WHEN len(u.unknown) > 0 THEN 'Unknown permission(s): ' || array_to_string(u.unknown, ', ') END AS error,
       CAST(NULL AS VARCHAR) AS permissions, CAST(NULL AS TIMESTAMP) AS updated_at
FROM access_requests r
JOIN (SELECT request_id,
             list_sort(list_distinct(list_filter(permissions, lambda x: NOT list_contains({_KNOWN}, x)))) AS unknown
      FROM access_requests) u ON r.request_id = u.request_id
LEFT JOIN access_controls a ON r.user_id = a.user_id
UNION ALL
SELECT 'snapshot', a.user_id, NULL, NULL, NULL, NULL,
       array_to_string(CASE WHEN r.user_id IS NOT NULL THEN r.permissions ELSE a.permissions END, ','),
       CASE WHEN r.user_id IS NOT NULL THEN r.requested_at ELSE a.updated_at END
FROM access_controls a
LEFT JOIN {nth_request_sql('access_requests', 'user_id', 'DESC', _ACCEPTED_ACCESS)} r ON a.user_id = r.user_id AND r.rn = 1""",
          ("access_requests", "access_controls"))
def access_replace(spark, sf):
    table = stored.changed_copy(spark, sf, "access_controls", "user_id")
    before, requests = table.version(), V.access_requests(spark, sf)
    table.apply("replace-1", requests, lambda rows: U.access_replace(rows, requests)[0])
    snap, outcomes = table.read(), U.access_replace(table.lookup(requests, before), requests)[1]
    return _both(snap.select("user_id", F.array_join("permissions", ",").alias("permissions"), "updated_at"),
                 outcomes.select("user_id", "request_id", "requested_at", "status_code", "error"))


@register("permissions_unknown", f"""
SELECT user_id, array_to_string(list_sort(list_distinct(list_filter(permissions,
       lambda x: NOT list_contains({_KNOWN}, x)))), ',') AS unknown FROM access_controls""", ("access_controls",))
def permissions_unknown(spark, sf):
    from tidemark.functions import scalars as S
    a = V.access_controls(spark, sf)
    return a.select("user_id", F.array_join(S.permissions_unknown("permissions"), ",").alias("unknown"))


@register("permissions_sorted", "SELECT user_id, array_to_string(list_sort(permissions), ',') AS sorted FROM access_controls",
          ("access_controls",))
def permissions_sorted(spark, sf):
    from tidemark.functions import scalars as S
    a = V.access_controls(spark, sf)
    return a.select("user_id", F.array_join(S.permissions_sorted("permissions"), ",").alias("sorted"))


@register("validate_enum", """
SELECT forecast_id, status, CASE WHEN status IN ('active', 'superseded', 'archived') THEN 200 ELSE 400 END AS status_code
FROM forecast_status_requests""", ("forecast_status_requests",))
def validate_enum(spark, sf):
    r = Val.validate_enum(V.forecast_status_requests(spark, sf), "status", vocab.FORECAST_STATUSES)
    return r.select("forecast_id", "status", "status_code")


@register("forecast_status_update", f"""
SELECT 'outcome' AS part, r.forecast_id, r.status,
       CASE WHEN r.status NOT IN ('active', 'superseded', 'archived') THEN 400
            WHEN f.forecast_id IS NULL THEN 404 ELSE 200 END AS status_code, CAST(NULL AS TIMESTAMP) AS updated_at
FROM forecast_status_requests r LEFT JOIN forecasts f ON r.forecast_id = f.forecast_id
UNION ALL
SELECT 'snapshot', f.forecast_id, COALESCE(r.status, f.status), NULL, r.requested_at
FROM forecasts f LEFT JOIN (SELECT * FROM forecast_status_requests WHERE status IN ('active', 'superseded', 'archived')) r
  ON f.forecast_id = r.forecast_id""",
          ("forecast_status_requests", "forecasts"))
def forecast_status_update(spark, sf):
    snap, outcomes = U.forecast_status_update(V.forecasts(spark, sf), V.forecast_status_requests(spark, sf))
    return _both(snap.select("forecast_id", "status", "updated_at"), outcomes.select("forecast_id", "status", "status_code"))


@register("whitelist_update_fields", "SELECT source_id, request_id, kept_fields FROM checked_patches", ("checked_patches",))
def whitelist_update_fields(spark, sf):
    p = V.source_patches(spark, sf)
    kept = Val.whitelist_update_fields("patch")
    return p.select("source_id", "request_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept_fields"))


def _newest(field: str) -> str:
    return (f"(SELECT source_id, p_{field} AS v FROM {nth_request_sql('checked_patches', 'source_id', 'DESC', f'error IS NULL AND p_{field} IS NOT NULL')} x "
            f"WHERE rn = 1)")


@register("data_source_patch", f"""
SELECT 'outcome' AS part, p.source_id, p.request_id, p.requested_at,
       CASE WHEN p.error IS NOT NULL THEN 400 WHEN d.source_id IS NULL THEN 404 ELSE 200 END AS status_code, p.error,
       CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS records_processed,
       CAST(NULL AS DOUBLE) AS data_quality, CAST(NULL AS TIMESTAMP) AS updated_at
FROM checked_patches p LEFT JOIN data_sources d ON p.source_id = d.source_id
UNION ALL
SELECT 'snapshot', d.source_id, NULL, NULL, NULL, NULL, COALESCE(n.v, d.name), COALESCE(s.v, d.status),
       COALESCE(CAST(r.v AS BIGINT), d.records_processed), COALESCE(CAST(q.v AS DOUBLE), d.data_quality),
       COALESCE(u.at, d.updated_at)
FROM data_sources d
LEFT JOIN {_newest('name')} n ON d.source_id = n.source_id LEFT JOIN {_newest('status')} s ON d.source_id = s.source_id
LEFT JOIN {_newest('records_processed')} r ON d.source_id = r.source_id
LEFT JOIN {_newest('data_quality')} q ON d.source_id = q.source_id
LEFT JOIN (SELECT source_id, max(requested_at) AS at FROM checked_patches WHERE error IS NULL GROUP BY 1) u
  ON d.source_id = u.source_id""", ("data_sources", "checked_patches"))
def data_source_patch(spark, sf):
    table = stored.changed_copy(spark, sf, "data_sources", "source_id")
    before, patches = table.version(), V.source_patches(spark, sf)
    table.apply("patches-1", patches, lambda rows: U.data_source_patch(rows, patches)[0])
    snap, outcomes = table.read(), U.data_source_patch(table.lookup(patches, before), patches)[1]
    return _both(snap.select("source_id", "name", "status", "records_processed", "data_quality", "updated_at"),
                 outcomes.select("source_id", "request_id", "requested_at", "status_code", "error"))


@register("report_generate", f"""
SELECT p.report_id, CASE WHEN r.report_id IS NOT NULL THEN 'ready' ELSE p.status END AS status,
       CASE WHEN r.report_id IS NOT NULL THEN r.requested_at ELSE p.generated_at END AS generated_at,
       CASE WHEN r.report_id IS NOT NULL THEN 'reports/' || p.report_id || '/' || {iso_sql('r.requested_at')} || '.json'
            ELSE p.object_key END AS object_key
FROM reports p LEFT JOIN {nth_request_sql('report_requests', 'report_id', 'DESC')} r ON p.report_id = r.report_id AND r.rn = 1""",
          ("reports", "report_requests"))
def report_generate(spark, sf):
    table = stored.changed_copy(spark, sf, "reports", "report_id")
    requests = V.report_requests(spark, sf)
    table.apply("reports-1", requests, lambda rows: U.report_generate(rows, requests)[0])
    return table.read().select("report_id", "status", "generated_at", "object_key")


@register("sink_report_json", f"""
SELECT p.report_id, 'reports/' || p.report_id || '/' || {iso_sql('r.requested_at')} || '.json' AS object_key,
       p.report_type AS report_type, {iso_sql('r.requested_at')} AS generated_at,
       CASE WHEN b.rn IS NULL THEN p.status ELSE 'ready' END AS was_status,
       CASE WHEN b.rn IS NOT NULL THEN 'reports/' || p.report_id || '/' || {iso_sql('b.requested_at')} || '.json' END AS was_key
FROM reports p JOIN {nth_request_sql('report_requests', 'report_id')} r ON p.report_id = r.report_id
LEFT JOIN {nth_request_sql('report_requests', 'report_id')} b ON r.report_id = b.report_id AND b.rn = r.rn - 1""",
          ("reports", "report_requests"))
def sink_report_json(spark, sf):
    """One artifact per request, each embedding the record as read before it."""
    _, artifacts = U.report_generate(V.reports(spark, sf), V.report_requests(spark, sf))
    path = scratch_path(spark, "report_artifacts")
    files.sink_json_lines(artifacts, path, ("generated_month",))
    back = spark.read.schema("report_id string, object_key string, artifact string, generated_month string").json(path)

    def field(name):
        return F.get_json_object("artifact", f"$.{name}")

    return back.select("report_id", "object_key", field("reportType").alias("report_type"),
                       field("generatedAt").alias("generated_at"), field("definition.status").alias("was_status"),
                       field("definition.object_key").alias("was_key"))


@register("scenario_run_record", f"""
SELECT 'outcome' AS part, r.scenario_id, r.run_id, CASE WHEN s.scenario_id IS NULL THEN 'rejected' ELSE 'queued' END AS run_status,
       CASE WHEN s.scenario_id IS NULL THEN 404 ELSE 200 END AS status_code, CAST(NULL AS VARCHAR) AS status,
       CAST(NULL AS VARCHAR) AS last_run_id, CAST(NULL AS TIMESTAMP) AS last_run_at
FROM scenario_run_requests r LEFT JOIN scenarios s ON r.scenario_id = s.scenario_id
UNION ALL
SELECT 'snapshot', s.scenario_id, NULL, NULL, NULL, CASE WHEN r.run_id IS NOT NULL THEN 'queued' ELSE s.status END,
       COALESCE(r.run_id, s.last_run_id), COALESCE(r.requested_at, s.last_run_at)
FROM scenarios s LEFT JOIN {_latest('scenario_run_requests', 'scenario_id')} r ON s.scenario_id = r.scenario_id""",
          ("scenario_run_requests", "scenarios"))
def scenario_run_record(spark, sf):
    snap, runs = U.scenario_run_record(V.scenarios(spark, sf), V.scenario_run_requests(spark, sf))
    return _both(snap.select("scenario_id", "status", "last_run_id", "last_run_at"),
                 runs.select("scenario_id", "run_id", "run_status", "status_code"))
