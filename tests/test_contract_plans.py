"""Driver contract, plan properties, streaming intake end to end."""

import json
import sys

import __spark_entry__ as entry_mod
from tidemark.operators import alerts as A
from tidemark.plans import views as V
from tidemark.session import scratch_path
from tidemark.sources import events as E
from tidemark.sources import files
from tidemark.streaming import alarms as ST

SF = "/root/testdata/sf0.001"
PY_NODES = ("MapInPandas", "MapInArrow", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "PythonUDF")


def test_every_query_has_oracle_sql():
    from tidemark.plans import registry
    q, o = registry.queries(), registry.oracle_sql()
    assert len(q) == 96 and set(q) == set(o)  # the 92 operators, the event path, page borders, streamed changes, refreshed months
    assert set(q) <= set(entry_mod.queries()) and set(o) <= set(entry_mod.oracle_sql())


def test_entry_survives_a_missing_dependency(monkeypatch):
    """Without a package that the training-data queries need, the others are all there."""
    from tidemark.plans import registry
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)  # importing it raises ImportError
    assert set(entry_mod.queries()) == set(registry.queries()) and set(entry_mod.oracle_sql()) == set(registry.oracle_sql())


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"year", "month", "orders", "revenue"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_score_forecast_runs_python(spark):
    q = entry_mod.queries()
    for name in ("dedupe_latest", "window_stats", "alarm_consecutive", "baseline_quantiles", "alarm_to_alert",
                 "acknowledge_alerts", "next_periods", "latest_kpi_per_series"):
        plan = _plan(q[name](spark, SF))
        assert not any(n in plan for n in PY_NODES), name
    assert "MapInArrow" in _plan(q["score_forecast"](spark, SF))


def test_scan_reads_only_needed_columns(spark):
    p = _plan(V.sales_raw(spark, SF))
    assert "l_returnflag" not in p and "l_discount" not in p and "o_totalprice" not in p
    p2 = _plan(V.sales_raw(spark, SF).filter("order_id is not null").select("product_id"))
    assert "o_orderpriority" not in p2


def test_stream_alarm_intake_end_to_end(spark):
    base = scratch_path(spark, "test_intake")
    files.sink_text(V.alarm_events(spark, SF).select("payload"), f"{base}/landing")
    ST.run_alarm_intake(spark, f"{base}/landing", f"{base}/out", f"{base}/ck", max_files_per_trigger=1)
    alerts = spark.read.parquet(f"{base}/out/alerts")
    notes = spark.read.parquet(f"{base}/out/notifications")
    dead = spark.read.parquet(f"{base}/out/dead_letters")
    batch = V.alerts(spark, SF)
    assert alerts.count() == batch.count()
    assert notes.count() == batch.filter("alert_type = 'critical'").count()
    assert dead.count() == V.alarm_events(spark, SF).filter("event_id % 97 = 0 or event_id % 83 = 0").count()
    assert files.read_runs(spark, f"{base}/out/metrics").count() == batch.count()
    body = json.loads(notes.first().body)
    assert set(body) == {"title", "message", "category", "timestamp"}
    # replaying the stream from its checkpoint adds nothing
    ST.run_alarm_intake(spark, f"{base}/landing", f"{base}/out", f"{base}/ck")
    assert spark.read.parquet(f"{base}/out/alerts").count() == batch.count()


def test_an_event_delivered_twice_counts_once(spark):
    """The same events in a later file, in the same file and after a restart."""
    base = scratch_path(spark, "test_intake_twice")
    events = V.alarm_events(spark, SF).select("payload")
    twice = events.filter("payload like '%2%'")
    for part in (events, twice.union(twice)):
        part.coalesce(2).write.mode("append").text(f"{base}/landing")
    ST.run_alarm_intake(spark, f"{base}/landing", f"{base}/out", f"{base}/ck", max_files_per_trigger=1)
    twice.coalesce(1).write.mode("append").text(f"{base}/landing")
    ST.run_alarm_intake(spark, f"{base}/landing", f"{base}/out", f"{base}/ck")
    batch = V.alerts(spark, SF)
    alerts = spark.read.parquet(f"{base}/out/alerts")
    assert alerts.count() == batch.count() == alerts.select("alert_id").distinct().count()
    notes = spark.read.parquet(f"{base}/out/notifications")
    assert notes.count() == batch.filter("alert_type = 'critical'").count()


def test_a_cut_delivery_does_not_hide_the_whole_one(spark):
    base = scratch_path(spark, "test_intake_cut")
    whole = V.alarm_events(spark, SF).filter("event_id % 97 = 1 and event_id % 79 != 0 and event_id % 83 != 0").select("payload")
    cut = whole.selectExpr("substring(payload, 1, 60) as payload")
    cut.coalesce(1).write.text(f"{base}/landing")
    ST.run_alarm_intake(spark, f"{base}/landing", f"{base}/out", f"{base}/ck")
    whole.coalesce(1).write.mode("append").text(f"{base}/landing")
    ST.run_alarm_intake(spark, f"{base}/landing", f"{base}/out", f"{base}/ck")
    assert spark.read.parquet(f"{base}/out/dead_letters").count() == whole.count()
    good = E.accept_alarm_events(E.parse_alarm_events(whole)[0])
    assert spark.read.parquet(f"{base}/out/alerts").count() == A.alarm_to_alert(good).count() > 0


def test_pandas_scorer_runs_outside_the_repo(tmp_path):
    """Executors import the package from the shipped zip, not from the cwd."""
    import subprocess
    import sys as _sys
    repo = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('se', {repo + '/__spark_entry__.py'!r})\n"
        "se = importlib.util.module_from_spec(spec); spec.loader.exec_module(se)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        "print('ROWS', se.queries()['score_forecast'](spark, '/root/testdata/sf0.001').count())\n")
    out = subprocess.run([_sys.executable, str(script)], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert "ROWS " in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS ")[1].split()[0]) > 0


def test_no_cross_joins_and_python_only_in_scorers(spark):
    """Audit every registered plan: no Cartesian / nested-loop joins, and
    Python runs only where the model is called."""
    banned = ("CartesianProduct", "BroadcastNestedLoopJoin")
    found = {}
    from tidemark.plans import registry
    for name, fn in registry.queries().items():
        plan = _plan(fn(spark, SF))
        hits = [k for k in banned + PY_NODES if k in plan]
        if hits:
            found[name] = hits
    scorers = ("score_forecast", "what_if_score", "forecast_record", "interval_confidence")
    assert found == {name: ["MapInArrow"] for name in scorers}
