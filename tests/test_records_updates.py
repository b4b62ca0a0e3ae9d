"""Record reads and guarded updates."""

import datetime as dt
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import records as R
from tidemark.operators import updates as U
from tidemark.operators import validate as Val
from tidemark.functions import scalars as S

T = dt.datetime(2026, 1, 1)


def test_forecasts_by_product_and_limit_bounds(spark):
    fc = spark.createDataFrame([("fc-1", "p-1", T), ("fc-2", "p-2", T)], "forecast_id string, product_id string, created_at timestamp_ntz")
    out = R.forecasts_by_product(fc, 50, products=spark.createDataFrame([("p-1",)], "product_id string")).collect()
    assert [(r.forecast_id, r.pos) for r in out] == [("fc-1", 1)]
    with pytest.raises(ValueError):
        R.forecasts_by_product(fc, 9999)
    lim = spark.createDataFrame([("9999",), ("50",), (None,), ("x",)], "limit string")
    codes = [r.status_code for r in Val.validate_page_size(lim).collect()]
    assert codes == [400, 200, 200, 400]


def test_inventory_severity_sorts_as_text(spark):
    inv = spark.createDataFrame([(f"ia-{s}", "p-1", s) for s in ("low", "medium", "high", "critical")],
                                "alert_id string, product_id string, severity string")
    assert [r.severity for r in R.inventory_alerts_by_product(inv).collect()] == ["critical", "high", "low", "medium"]
    assert [r.severity for r in R.top_alerts(inv, 3).collect()] == ["critical", "high", "medium"]


def test_latest_kpi_per_series_prefers_present_timestamp(spark):
    k = spark.createDataFrame(
        [("k1", "2026-01-01", "a", "1", "up"), ("k1", "2026-01-03", "a", "3", "up"), ("k1", None, "a", "9", "up"),
         ("k2", "2026-01-02", "b", "2", "down")],
        "kpi_id string, ts string, label string, value string, trend string")
    out = [(r.kpi_id, r.value) for r in R.latest_kpi_per_series(k).collect()]
    assert out == [("k1", "3"), ("k2", "2")]


def test_ttl_retention(spark):
    df = spark.createDataFrame([("a", 100), ("b", 300), ("c", None)], "id string, ttl long")
    assert sorted(r.id for r in R.ttl_retention(df, 200).collect()) == ["b", "c"]


def walked(df, key, size):
    """All pages by the cursor, as lists of rows."""
    out, token = [], None
    while True:
        page = R.page_keyset(df, key, size, token)
        out.append([tuple(r) for r in page.items.collect()])
        token = page.next_token
        if token is None:
            return out


def test_keyset_pages_walk_the_cursor(spark):
    df = spark.range(0, 25).select(F.format_string("k%03d", "id").alias("k"))
    pages = walked(df, "k", 10)
    assert [len(p) for p in pages] == [10, 10, 5]
    assert [r[0] for p in pages for r in p] == [f"k{i:03d}" for i in range(25)]
    assert R.page_keyset(df, "k", 25).next_token is None  # a full last page has no next one
    assert walked(df.limit(0), "k", 10) == [[]]
    directory = {r.page: (r.first_key, r.last_key, r.n_rows, r.has_next) for r in R.page_directory(df, "k", 10).collect()}
    assert directory == {1: ("k000", "k009", 10, True), 2: ("k010", "k019", 10, True), 3: ("k020", "k024", 5, False)}
    plan = R.page_keyset(df, "k", 10, R.page_keyset(df, "k", 10).next_token).items._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("kind,make", [
    ("long", lambda i: i * 7), ("date", lambda i: dt.date(2026, 1, 1) + dt.timedelta(days=i)),
    ("timestamp_ntz", lambda i: dt.datetime(2026, 1, 1, 0, 0, 0, i)), ("decimal(20,3)", lambda i: Decimal(i) / 8 * 8 + Decimal("0.125").quantize(Decimal("0.001"))),
    ("double", lambda i: i / 7), ("boolean", lambda i: i % 2 == 0), ("string", lambda i: f"é'{i:02d}\n"),
])
def test_every_row_is_on_one_page_whatever_the_key(spark, kind, make):
    """Typed keys; keys that are null, repeated, or whole rows that are."""
    rows = [(make(i), f"r{i}", {"m": str(i)}) for i in range(23)] + [(None, f"n{i}", None) for i in range(5)]
    rows += [rows[3]] * 6 + [(rows[4][0], "other", None)] * 2 + [(None, "n1", None)] * 3
    df = spark.createDataFrame(rows, f"k {kind}, v string, m map<string,string>").repartition(3)
    pages = walked(df.select("k", "v", F.col("m")["m"].alias("m")), "k", 4)
    got = [r for p in pages for r in p]
    plain = [(k, v, (m or {}).get("m")) for k, v, m in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, plain))
    assert [len(p) for p in pages] == [4] * (len(rows) // 4) + ([len(rows) % 4] if len(rows) % 4 else [])
    keys = [r[0] for r in got]
    present = [k for k in keys if k is not None]
    assert present == sorted(present) and all(k is None for k in keys[len(present):])
    assert {r["page"]: r["count"] for r in R.paged(df, "k", 4).groupBy("page").count().collect()} == {
        i + 1: len(p) for i, p in enumerate(pages)}


def test_page_tokens(spark):
    token = R.page_keyset(spark.range(9), "id", 2).next_token
    assert R.PageCursor.parse(token, spark.range(3), "id").value == "1"
    for bad in ("!!not-base64!!", "bm90IGpzb24=", "WzFd", "e30=", R.PageCursor("other", "bigint", "1", 0, 1).token(),
                R.PageCursor("id", "string", "1", 0, 1).token(), R.PageCursor("id", "bigint", 1, 0, 1).token()):
        with pytest.raises(R.InvalidPageToken):
            R.page_keyset(spark.range(3), "id", 2, bad)
    with pytest.raises(ValueError):
        R.paged(spark.range(3).withColumn("page", F.lit(1)), "id", 2)
    with pytest.raises(TypeError):
        R.page_keyset(spark.sql("select array(1) as a"), "a", 2)


def test_expiring_rows(spark):
    import os

    from tidemark.session import scratch_path
    from tidemark.sources import files
    day = 86_400
    rows = [(i, None if i % 10 == 0 else 20_000 * day + i * 3600) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, ttl long")
    path = scratch_path(spark, "test_expiry")
    files.sink_expiring(df, path, "r1")
    files.sink_expiring(df, path, "r1")  # repeated: each row once
    as_of = 20_002 * day + 1800 * 5
    kept = files.read_unexpired(spark, path, as_of)
    want = sorted(i for i, t in rows if t is None or t > as_of)
    assert sorted(r.id for r in kept.collect()) == want and kept.columns == ["id", "ttl"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(expires_on" in plan
    before = {d: os.stat(f"{path}/{d}").st_mtime for d in os.listdir(path) if d.startswith("expires_on")}
    assert len(files.drop_expired(spark, path, as_of)) == 2
    left = {d: os.stat(f"{path}/{d}").st_mtime for d in os.listdir(path) if d.startswith("expires_on")}
    assert len(before) - len(left) == 2 and all(before[d] == t for d, t in left.items())
    assert sorted(r.id for r in files.read_unexpired(spark, path, as_of).collect()) == want


def test_inventory_alerts_have_no_limit(spark):
    inv = spark.range(0, 450).select(F.format_string("ia-%03d", "id").alias("alert_id"), F.lit("p-1").alias("product_id"),
                                     F.lit("low").alias("severity"))
    assert R.inventory_alerts_by_product(inv).count() == 450


def test_positions_follow_the_order_across_tasks(spark):
    rows = [(None if i % 7 == 0 else ("hot" if i % 3 else f"k{i % 5}"), (i * 37) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    got = R.with_positions(df, "k", [F.col("v").desc()]).collect()
    by_key = {}
    for r in sorted(got, key=lambda r: r.pos):
        by_key.setdefault(r.k, []).append((r.pos, r.v))
    for k, seen in by_key.items():
        assert [p for p, _ in seen] == list(range(1, len(seen) + 1))
        assert [v for _, v in seen] == sorted((v for key, v in rows if key == k), reverse=True)
    assert R.with_positions(df.limit(0), "k", [F.col("v")]).collect() == []


def test_index_scan_pushes_the_key(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.format_string("m%d", F.col("id") % 5).alias("metric_id"), F.col("id").alias("ts")).write.parquet(path)
    df = R.scan_index_eq(spark.read.parquet(path), "metric_id", ["m1", "m3"], [F.col("ts").desc()])
    assert df.count() == 40
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(metric_id" in plan


def test_missing_fields_list(spark):
    df = spark.createDataFrame([("1", "", None)], "a string, b string, c string")
    r = Val.validate_required(df, ["a", "b", "c"]).collect()[0]
    assert (r.missing, r.status_code) == ("b, c", 400)
    zero = spark.createDataFrame([(0, False)], "n int, f boolean")
    assert Val.validate_required(zero, ["n", "f"]).collect()[0].status_code == 200


def test_forecast_status_update_outcomes(spark):
    fc = spark.createDataFrame([("fc-1", "active", None)], "forecast_id string, status string, updated_at timestamp_ntz")
    req = spark.createDataFrame([("fc-missing", "archived", T), ("fc-1", "bogus", T)],
                                "forecast_id string, status string, requested_at timestamp_ntz")
    snap, out = U.forecast_status_update(fc, req)
    codes = {r.forecast_id: r.status_code for r in out.collect()}
    assert codes == {"fc-missing": 404, "fc-1": 400}
    assert snap.collect()[0].status == "active"


def test_data_source_patch_whitelist(spark):
    ds = spark.createDataFrame([("ds-1", "n", "active", 5, 90.0, None)],
                               "source_id string, name string, status string, records_processed long, "
                               "data_quality double, updated_at timestamp_ntz")
    req = spark.sql("""select 'ds-1' source_id, map('status','error','records_processed','7','owner','x') patch,
                       timestamp_ntz'2026-01-01 00:00:00' requested_at
                       union all select 'ds-1', map('owner','y'), timestamp_ntz'2025-01-01 00:00:00'
                       union all select 'ds-1', map('status','paused'), timestamp_ntz'2025-01-01 00:00:00'""")
    snap, out = U.data_source_patch(ds, req)
    s = snap.collect()[0]
    assert (s.status, s.records_processed, s.name) == ("error", 7, "n") and s.updated_at is not None
    assert sorted(r.status_code for r in out.collect()) == [200, 400, 400]


def test_access_replace_validates_and_audits(spark):
    acl = spark.createDataFrame([("u-1", ["view_forecasts"], None)], "user_id string, permissions array<string>, updated_at timestamp_ntz")
    req = spark.createDataFrame([("u-1", ["manage_users", "data_access"], "admin", T), ("u-1", ["root"], "admin", T),
                                 ("u-2", ["data_access"], None, T)],
                                "user_id string, permissions array<string>, actor string, requested_at timestamp_ntz")
    snap, out, audit = U.access_replace(acl, req)
    assert sorted(r.status_code for r in out.collect()) == [200, 400, 404]
    a = audit.collect()
    assert len(a) == 1 and a[0].before == ["view_forecasts"] and a[0].after == ["data_access", "manage_users"]
    u = spark.createDataFrame([(["b", "view_forecasts", "a", "a"],)], "p array<string>")
    assert u.select(S.permissions_unknown("p")).collect()[0][0] == ["a", "b"]


def test_apply_if_proposed_once(spark):
    opt = spark.createDataFrame([("o1", "proposed", None), ("o2", "applied", None)],
                                "optimization_id string, status string, applied_at timestamp_ntz")
    req = spark.createDataFrame([("o1", T), ("o1", T + dt.timedelta(hours=1)), ("o2", T), ("o9", T)],
                                "optimization_id string, requested_at timestamp_ntz")
    snap, out = U.apply_if_proposed(opt, req)
    res = sorted((r.optimization_id, r.outcome) for r in out.collect())
    assert res == [("o1", "applied"), ("o1", "not_found_or_applied"), ("o2", "not_found_or_applied"),
                   ("o9", "not_found_or_applied")]
    assert {r.optimization_id: r.status for r in snap.collect()} == {"o1": "applied", "o2": "applied"}


def test_scenario_run_checks_id_before_dispatch(spark):
    sc = spark.createDataFrame([("sc-1", "draft", None, None, None)],
                               "scenario_id string, status string, last_run_id string, last_run_at timestamp_ntz, updated_at timestamp_ntz")
    runs = spark.createDataFrame([("sc-1", "run-a", T), ("sc-9", "run-b", T)], "scenario_id string, run_id string, requested_at timestamp_ntz")
    snap, rec = U.scenario_run_record(sc, runs, executor_available=True)
    assert {r.run_id: r.run_status for r in rec.collect()} == {"run-a": "running", "run-b": "rejected"}
    s = snap.collect()[0]
    assert (s.status, s.last_run_id) == ("running", "run-a")


def test_ingestion_stats_dashboard_rows(spark):
    ds = spark.createDataFrame([("sales-data", "S3", "active", 2847392, 98.5), ("market-trends", "API", "processing", 156789, 96.2),
                                ("inventory-stream", "Kinesis", "active", 45623, 99.1), ("supplier-data", "RDS", "idle", 12456, 94.7)],
                               "name string, source_type string, status string, records_processed long, data_quality double")
    r = M.ingestion_stats(ds).collect()[0]
    assert (r.total_records, r.processed_today, r.data_quality_avg, r.pipeline_health) == (3062260, 153113, 97.1, 50.0)


def test_horizon_truncates_before_range_check(spark):
    req = spark.createDataFrame([("a", [("2026-01", 1.0)], 24.9), ("b", [("2026-01", 1.0)], 25.2), ("c", [("2026-01", 1.0)], 0.5)],
                                "product_id string, history array<struct<period:string,demand:double>>, horizon double")
    out = {r.product_id: (r.status_code, r.horizon) for r in Val.validate_inference_request(req).collect()}
    assert out == {"a": (200, 24), "b": (400, 25), "c": (400, 0)}


def test_page_size_text_rules(spark):
    lim = spark.createDataFrame([(" 7 ",), ("5.5",), ("0",), ("200",), ("201",)], "limit string")
    assert [r.status_code for r in Val.validate_page_size(lim).collect()] == [200, 400, 400, 200, 400]


def test_metric_emission_is_best_effort(spark):
    from tidemark.sources import files
    m = spark.createDataFrame([("x", 1.0)], "metric_name string, value double")
    assert files.emit_metrics(m, "/proc/not-writable/metrics", "r1") is False


def test_dead_letter_retention(spark):
    from tidemark.sources import events as E
    dead = spark.createDataFrame([("{bad", dt.datetime(2026, 1, 1)), ("{bad2", dt.datetime(2026, 1, 20))], "payload string, ts timestamp_ntz")
    kept = E.dead_letters(dead, as_of=dt.datetime(2026, 1, 16)).collect()
    assert [r.payload for r in kept] == ["{bad2"]


def test_catalog_table_recovers_new_partitions(spark):
    from tidemark.session import scratch_path
    from tidemark.sources import files
    base = scratch_path(spark, "test_catalog")
    df = spark.createDataFrame([(1, 2026, 1)], "v int, year int, month int")
    files.sink_parquet_partitioned(df, base)
    assert files.catalog_table(spark, "t_catalog_probe", base).count() == 1
    files.sink_parquet_partitioned(spark.createDataFrame([(2, 2026, 2)], df.schema), base)
    t = files.catalog_table(spark, "t_catalog_probe", base)
    assert sorted((r.year, r.month) for r in t.select("year", "month").collect()) == [(2026, 1), (2026, 2)]
    more = spark.createDataFrame([(3, "x", 2026, 3)], "v int, extra string, year int, month int")
    files.sink_parquet_partitioned(more, base)  # a column that came later reaches the catalog
    t = files.catalog_table(spark, "t_catalog_probe", base)
    assert sorted((r.v, r.extra) for r in t.select("v", "extra").collect()) == [(1, None), (2, None), (3, "x")]
    shutil.rmtree(f"{base}/year=2026/month=1")  # a folder that is gone is no reason to drop its partition
    t = files.catalog_table(spark, "t_catalog_probe", base)
    assert {r[0] for r in spark.sql("SHOW PARTITIONS t_catalog_probe").collect()} == {f"year=2026/month={m}" for m in (1, 2, 3)}
    assert sorted(r.v for r in t.select("v").collect()) == [2, 3]
    spark.sql("DROP TABLE t_catalog_probe")


def test_discovery_reports_added_changed_and_deleted_partitions(spark):
    from tidemark.session import scratch_path
    from tidemark.sources import files
    base, manifest = scratch_path(spark, "test_discovery"), scratch_path(spark, "test_manifest")
    write = lambda *rows: files.sink_parquet_partitioned(spark.createDataFrame(rows, "v int, year int, month int"), base)
    found = lambda: {tuple(r) for r in files.discover_partitions(spark, base, manifest).collect()}
    write((1, 2026, 1), (2, 2026, 2))
    assert found() == {("year=2026/month=1", "added"), ("year=2026/month=2", "added")}
    assert found() == set()
    shutil.rmtree(f"{base}/year=2026/month=1")
    write((5, 2026, 2), (6, 2026, 2), (3, 2026, 3))
    assert found() == {("year=2026/month=1", "deleted"), ("year=2026/month=2", "changed"), ("year=2026/month=3", "added")}
    assert found() == set()


def test_a_repeated_run_leaves_each_row_once(spark):
    from tidemark.session import scratch_path
    from tidemark.sources import files
    path = scratch_path(spark, "test_runs")
    for run in ("r1", "r1", "r2"):
        files.sink_run(spark.createDataFrame([(run,)], "v string"), path, run)
    assert sorted(r.v for r in files.read_runs(spark, path).collect()) == ["r1", "r2"]


def test_null_permissions_and_null_status_are_rejected(spark):
    acl = spark.createDataFrame([("u-1", ["view_forecasts"], None)], "user_id string, permissions array<string>, updated_at timestamp_ntz")
    req = spark.createDataFrame([("u-1", None, "a", T), ("u-1", ["data_access", None], "a", T)],
                                "user_id string, permissions array<string>, actor string, requested_at timestamp_ntz")
    snap, out, audit = U.access_replace(acl, req)
    assert [r.status_code for r in out.collect()] == [400, 400]
    assert snap.collect()[0].permissions == ["view_forecasts"] and audit.count() == 0
    ds = spark.createDataFrame([("ds-1", "n", "active", 5, 90.0, None)],
                               "source_id string, name string, status string, records_processed long, "
                               "data_quality double, updated_at timestamp_ntz")
    p = spark.sql("select 'ds-1' source_id, map('status', cast(null as string)) patch, timestamp_ntz'2026-01-01 00:00:00' requested_at")
    snap2, out2 = U.data_source_patch(ds, p)
    assert out2.collect()[0].status_code == 400 and snap2.collect()[0].status == "active"


def test_report_generate_snapshot_and_artifact(spark):
    import json
    rep = spark.createDataFrame([("r1", "Q1", None, "generating", T, None, None), ("r2", "Q2", "executive", "generating", None, None, None)],
                                "report_id string, title string, report_type string, status string, created_at timestamp_ntz, "
                                "generated_at timestamp_ntz, object_key string")
    req = spark.createDataFrame([("r1", dt.datetime(2026, 2, 1, 8, 30)), ("r9", T)], "report_id string, requested_at timestamp_ntz")
    snap, art = U.report_generate(rep, req)
    s = {r.report_id: r for r in snap.collect()}
    assert (s["r1"].status, s["r1"].object_key) == ("ready", "reports/r1/2026-02-01T08:30:00.json")
    assert s["r2"].status == "generating" and "r9" not in s
    a = art.collect()
    assert len(a) == 1
    doc = json.loads(a[0].artifact)
    assert doc["reportType"] == "operational" and doc["generatedAt"] == "2026-02-01T08:30:00"
    assert doc["definition"]["title"] == "Q1"


def test_latest_forecast_breaks_ties_by_id(spark):
    from tidemark.operators import forecast as FC
    preds = "array<struct<period:string,demand:double,lower:double,upper:double>>"
    fc = spark.createDataFrame([("fc-a", "p", [("2026-01", 1.0, 0.0, 2.0)], T), ("fc-b", "p", [("2026-01", 5.0, 0.0, 9.0)], T),
                                ("fc-c", "p", [("2026-01", 7.0, 0.0, 9.0)], None)],
                               f"forecast_id string, product_id string, predictions {preds}, created_at timestamp_ntz")
    rows = FC.latest_forecast(fc).collect()
    assert [(r.forecast_id, r.demand) for r in rows] == [("fc-b", 5.0)]


def test_get_by_key_keeps_every_request(spark):
    t = spark.createDataFrame([("k1", "a"), ("k2", "b")], "k string, v string")
    req = spark.createDataFrame([("k1",), ("k1",), ("k3",)], "k string")
    out = sorted((r.k, r.v, r.found) for r in R.get_by_key(t, req, "k").collect())
    assert out == [("k1", "a", True), ("k1", "a", True), ("k3", None, False)]


def _at(minute):
    return T + dt.timedelta(minutes=minute)


SOURCES = "source_id string, name string, status string, records_processed long, data_quality double, updated_at timestamp_ntz"


def test_patches_of_one_source_add_up(spark):
    ds = spark.createDataFrame([("ds-1", "n", "active", 5, 90.0, None)], SOURCES)
    rows = [("r1", "ds-1", {"status": "idle"}, _at(0)), ("r2", "ds-1", {"name": "new"}, _at(1)),
            ("r3", "ds-1", {"records_processed": "lots"}, _at(2)), ("r4", "ds-1", {"name": "newer"}, _at(1)),
            ("r5", None, {"name": "x"}, _at(3)), ("r6", "ds-9", {"name": "x"}, _at(3)), ("r7", "ds-1", {"data_quality": None}, _at(0))]
    req = spark.createDataFrame(rows, "request_id string, source_id string, patch map<string,string>, requested_at timestamp_ntz")
    snap, out = U.data_source_patch(ds, req)
    s = snap.first()
    assert (s.status, s.name, s.records_processed, s.data_quality, s.updated_at) == ("idle", "newer", 5, None, _at(1))
    assert {r.request_id: r.status_code for r in out.collect()} == {
        "r1": 200, "r2": 200, "r3": 400, "r4": 200, "r5": 404, "r6": 404, "r7": 200}


def test_one_artifact_per_report_request_with_the_record_before_it(spark):
    import json
    rep = spark.createDataFrame([("r1", "Q1", "executive", "generating", T, None, None)],
                                "report_id string, title string, report_type string, status string, created_at timestamp_ntz, "
                                "generated_at timestamp_ntz, object_key string")
    req = spark.createDataFrame([("a", "r1", _at(1)), ("b", "r1", _at(2)), ("c", None, _at(1))],
                                "request_id string, report_id string, requested_at timestamp_ntz")
    snap, art = U.report_generate(rep, req)
    docs = {r.object_key: json.loads(r.artifact)["definition"] for r in art.collect()}
    first, second = "reports/r1/2026-01-01T00:01:00.json", "reports/r1/2026-01-01T00:02:00.json"
    assert set(docs) == {first, second}
    assert docs[first]["status"] == "generating" and "object_key" not in docs[first]
    assert docs[second]["status"] == "ready" and docs[second]["object_key"] == first
    assert snap.first().object_key == second


def test_audit_chains_the_changes_of_one_user(spark):
    acl = spark.createDataFrame([("u-1", ["data_access"], None)], "user_id string, permissions array<string>, updated_at timestamp_ntz")
    req = spark.createDataFrame([("a", "u-1", ["manage_users"], "x", _at(1)), ("b", "u-1", ["view_forecasts"], "x", _at(1)),
                                 ("c", "u-1", ["root"], "x", _at(1)), ("d", "u-1", ["data_access"], "x", _at(500)),
                                 ("e", "u-1", ["manage_users"], "x", _at(900))],
                                "request_id string, user_id string, permissions array<string>, actor string, requested_at timestamp_ntz")
    snap, _, audit = U.access_replace(acl, req)
    seen = [(r.before, r.after) for r in sorted(audit.collect(), key=lambda r: r["at"])]
    assert sorted(seen[:2]) == [(["data_access"], ["manage_users"]), (["manage_users"], ["view_forecasts"])]
    assert seen[2:] == [(["view_forecasts"], ["data_access"]), (["data_access"], ["manage_users"])]
    assert snap.first().permissions == ["manage_users"]


def test_apply_has_exactly_one_winner(spark):
    opt = spark.createDataFrame([("o1", "proposed", None)], "optimization_id string, status string, applied_at timestamp_ntz")
    req = spark.createDataFrame([("b", "o1", T), ("a", "o1", T), ("c", None, T)],
                                "request_id string, optimization_id string, requested_at timestamp_ntz")
    snap, out = U.apply_if_proposed(opt, req)
    assert {r.request_id: r.status_code for r in out.collect()} == {"a": 200, "b": 404, "c": 404}
    assert snap.first().status == "applied"


def test_scratch_of_the_application_can_be_removed(spark):
    import os
    from tidemark import session
    made = session.scratch_path(spark, "x")
    root = session._scratch_root(spark)
    assert made.startswith(root + "/x/")
    spark.range(1).write.parquet(made)
    local = made.removeprefix("file:")
    assert os.path.isdir(local)
    session.remove_scratch(spark)
    assert not os.path.exists(local)
