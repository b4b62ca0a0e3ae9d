"""Forecast scoring, period arithmetic, metric windows and alarms (batch and stream)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import forecast as FC
from tidemark.operators import metrics as M
from tidemark.operators import validate as Val
from tidemark.session import scratch_path
from tidemark.sources import versions
from tidemark.streaming import alarms as ST


def test_next_periods_rules(spark):
    cases = {"2026-12": ["2027-01", "2027-02"], "2026": ["t+1", "t+2"], "2026-13": ["2027-01", "2027-02"],
             "2026-6": ["2026-07", "2026-08"], "foo": ["t+1", "t+2"], "2026-07-15": ["2026-08", "2026-09"], "": ["t+1", "t+2"],
             "9999-12": ["10000-01", "10000-02"], "0-0": ["0000-01", "0000-02"]}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.n for r in df.select("p", S.next_periods("p", 2).alias("n")).collect()}
    assert got == cases


def test_context_tail_shorter_and_longer(spark):
    df = spark.createDataFrame([([1, 2, 3],), (list(range(100)),)], "a array<int>")
    out = [r.t for r in df.select(S.context_tail("a", 96).alias("t")).collect()]
    assert out[0] == [1, 2, 3] and out[1] == list(range(4, 100))


def test_validate_inference_request(spark):
    req = spark.createDataFrame(
        [("p-1", [("2026-07", 100.0)], 3), ("p-2", [], 3), ("p-3", [("2026-07", 1.0)], 99), ("p-4", [("2026-07", 1.0)], None)],
        "product_id string, history array<struct<period:string,demand:double>>, horizon int")
    out = {r.product_id: (r.status_code, r.horizon) for r in Val.validate_inference_request(req).collect()}
    assert out == {"p-1": (200, 3), "p-2": (400, 3), "p-3": (400, 99), "p-4": (200, 6)}


def test_pandas_scorer_equals_native_baseline(spark):
    rows = [("a", f"2025-{m:02d}", d) for m, d in zip(range(1, 13), [5, 9, 2, 14, 7, 7, 30, 1, 8, 12, 4, 6])]
    rows += [("b", "2026-11", 10), ("b", "2026-12", 20)]
    monthly = spark.createDataFrame(rows, "product_id string, period string, demand long")
    native = FC.baseline_quantiles(monthly, horizon=3).select("product_id", "step", "period", "demand", "lower", "upper")
    req = FC.collect_history(monthly).withColumn("horizon", F.lit(3))
    scored = FC.score_forecast(req).select("product_id", "step", "period", "demand", "lower", "upper")
    assert sorted(map(tuple, native.collect())) == sorted(map(tuple, scored.collect()))
    assert [r.period for r in scored.filter("product_id = 'b'").orderBy("step").collect()] == ["2027-01", "2027-02", "2027-03"]


AS_OF = dt.datetime(2026, 8, 1)


def test_plugin_scorer_and_record(spark):
    def factory():
        def score(series, lengths, horizon):
            rows = [[np.nanmin(r), np.nanmean(r), np.nanmax(r)] for r in series]
            return np.repeat(np.array(rows)[:, None, :], horizon, axis=1)
        return score

    monthly = spark.createDataFrame([("p-1", "2026-07", 100), ("p-2", "foo", 7), ("p-2", "bar", 9)],
                                    "product_id string, period string, demand long")
    req = FC.collect_history(monthly).withColumn("horizon", F.lit(3))
    preds = FC.score_forecast(req, factory)
    rec = {r.product_id: r for r in FC.forecast_record(preds, AS_OF).collect()}
    one = rec["p-1"]
    assert one.forecast_id.startswith("fc-") and one.status == "active" and one.model_version == "unknown"
    assert [p.period for p in one.predictions] == ["2026-08", "2026-09", "2026-10"] and one.created_at == AS_OF
    # this model states neither confidence nor accuracy; an unparsable period is kept
    assert one.confidence is None and one.accuracy is None
    assert [(p.period, p.demand, p.lower, p.upper) for p in rec["p-2"].predictions][0] == ("t+1", 8.0, 7.0, 9.0)


def test_forecast_records_of_several_runs(spark):
    """The id names product, run and version: a re-run repeats it, the next run does not."""
    monthly = spark.createDataFrame([("p-1", "2026-07", 100)], "product_id string, period string, demand long")
    preds = FC.baseline_quantiles(monthly, 3)
    ids = [FC.forecast_record(preds, at, v).collect()[0].forecast_id
           for at, v in ((AS_OF, "v1"), (AS_OF, "v1"), (AS_OF + dt.timedelta(days=1), "v1"), (AS_OF, "v2"))]
    assert ids[0] == ids[1] and len(set(ids)) == 3
    assert FC.forecast_record(preds, AS_OF).collect()[0].confidence == 0.8
    stated = preds.withColumn("confidence", F.lit(0.91)).withColumn("accuracy", F.lit(96.5))
    rec = FC.forecast_record(stated, AS_OF).collect()[0]
    assert (rec.confidence, rec.accuracy) == (0.91, 96.5)


def test_null_demand_is_rejected(spark):
    req = spark.createDataFrame([("p-1", [("2026-07", None)], 3), ("p-2", [("2026-06", 2.0), ("2026-07", 1.0)], 3)],
                                "product_id string, history array<struct<period:string,demand:double>>, horizon int")
    assert {r.product_id: r.status_code for r in Val.validate_inference_request(req).collect()} == {"p-1": 400, "p-2": 200}


def test_backtest_equals_records_joined_with_actuals(spark):
    rows = [("a", f"2025-{m:02d}", d) for m, d in zip(range(1, 13), [5, 9, 2, 14, 7, 7, 30, 1, 8, 12, 4, 6])]
    rows += [("b", "2025-11", 10), ("b", "2025-05", 20), ("c", "2025-11", 3)]
    monthly = spark.createDataFrame(rows, "product_id string, period string, demand long")
    got = FC.backtest(monthly, "2025-08", 3)
    past = FC.forecast_record(FC.baseline_quantiles(monthly.filter("period < '2025-08'"), 3), AS_OF)
    want = FC.forecast_vs_actual(past, monthly)
    cols = ["product_id", "period", "step", "demand", "actual", "accuracy"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 2


def test_forecast_vs_actual_demo_values(spark):
    demo = [("Jan", 850, 820, 96.5), ("Feb", 920, 890, 96.7), ("Mar", 1100, 1050, 95.5), ("Apr", 1250, 1180, 94.4),
            ("May", 1350, 1320, 97.8), ("Jun", 1400, None, None)]
    fc = spark.createDataFrame([("fc-1", "p", [(m, float(d), 0.0, 0.0) for m, d, _, _ in demo], None)],
                               "forecast_id string, product_id string, predictions array<struct<period:string,demand:double,lower:double,upper:double>>, created_at timestamp_ntz")
    actual = spark.createDataFrame([("p", m, a) for m, _, a, _ in demo if a is not None], "product_id string, period string, demand long")
    got = {r.period: r.accuracy for r in FC.forecast_vs_actual(fc, actual).collect()}
    assert got == {m: acc for m, _, _, acc in demo}


def _metrics(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = []
    # latency p99 over 3000 in periods 0,1,2 and 4; period 3 has no data (not breaching)
    for p, v in [(0, 3500.0), (1, 3600.0), (2, 3700.0), (4, 3900.0), (5, 3900.0), (6, 3900.0), (7, 100.0)]:
        rows.append(("Latency:api", t0 + dt.timedelta(seconds=300 * p + 10), "Latency", "api", v))
    # 5XX sum > 5 exactly at threshold (not breaching) and above
    rows.append(("5XXError:api", t0 + dt.timedelta(seconds=20), "5XXError", "api", 5.0))
    rows.append(("5XXError:api", t0 + dt.timedelta(seconds=320), "5XXError", "api", 6.0))
    rows.append(("Errors:alerts", t0 + dt.timedelta(seconds=30), "Errors", "alerts", 1.0))
    return spark.createDataFrame(rows, "metric_id string, ts timestamp_ntz, name string, dim_value string, value double")


def test_consecutive_alarm_and_transitions(spark):
    ev = M.alarm_consecutive(M.evaluate_rules(M.window_stats(_metrics(spark)), M.alarm_rules(spark)))
    lat = {r.period_start.minute: r.in_alarm for r in ev.filter("alarm = 'api-latency-p99'").collect()}
    assert lat == {0: False, 5: False, 10: True, 20: False, 25: False, 30: True, 35: False}
    x5 = {r.period_start.minute: r.breach for r in ev.filter("alarm = 'critical-api-5xx'").collect()}
    assert x5 == {0: False, 5: True}
    tr = sorted((r.alarm, r.changed_at.minute, r.state) for r in M.alarm_transitions(ev).collect())
    assert ("api-latency-p99", 10, "ALARM") in tr and ("api-latency-p99", 15, "OK") in tr
    assert ("api-latency-p99", 30, "ALARM") in tr and ("api-latency-p99", 35, "OK") in tr
    assert ("critical-alerts-errors", 0, "ALARM") in tr


def test_stream_windows_equal_batch_on_closed_windows(spark):
    m = _metrics(spark)
    base = scratch_path(spark, "test_stream")
    m.write.parquet(f"{base}/landing")
    ST.run_tumbling_metrics(spark, f"{base}/landing", m.schema, f"{base}/out", f"{base}/ck")
    streamed = spark.read.parquet(f"{base}/out").select("metric_id", "period_start", "sum", "samples")
    wm = dt.datetime(2026, 1, 1) + dt.timedelta(seconds=300 * 7 + 10) - dt.timedelta(minutes=10)
    batch = M.window_stats(m).filter(F.col("period_end") <= F.lit(wm)).select("metric_id", "period_start", "sum", "samples")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert streamed.count() > 0


def test_round_exact_matches_python_round(spark):
    import random
    random.seed(3)
    vals = [32.175, 12.125, 2.675, 0.125, 1.005, 4769.465, 329.195, 2.5, 3.5, 0.0]
    vals += [random.randint(0, 10**6) / random.choice([8, 40, 200, 1000]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(S.round_half_even("x", 2)).collect()]
    assert got == [round(v, 2) for v in vals]
    assert df.filter("x = 32.175").select(S.round_half_even("x", 2)).first()[0] == 32.17


def test_stream_consecutive_alarm_equals_batch(spark):
    """The stream gives the same N-period counts as the batch, for every sliding
    window closed by the watermark."""
    m = _metrics(spark)
    base = scratch_path(spark, "test_stream_consec")
    m.write.parquet(f"{base}/landing")
    ST.run_consecutive_alarm(spark, f"{base}/landing", m.schema, f"{base}/out", f"{base}/ck")
    got = {(r.window_end, r.breaching_periods, r.in_alarm)
           for r in ST.closed_windows(spark, f"{base}/out").filter("alarm = 'api-latency-p99'").collect()}
    ev = M.alarm_consecutive(M.evaluate_rules(M.window_stats(m), M.alarm_rules(spark)))
    batch = {r.period_start: r for r in ev.filter("alarm = 'api-latency-p99'").collect()}
    # the window ending right after a period with data holds that period as its last one
    for start, r in batch.items():
        end = start + dt.timedelta(seconds=300)
        wm = dt.datetime(2026, 1, 1) + dt.timedelta(seconds=300 * 7 + 10) - dt.timedelta(minutes=10)
        if end <= wm:
            match = [g for g in got if g[0] == end]
            assert match and match[0][2] == r.in_alarm, (start, match, r.in_alarm)


def test_percentiles_are_exact_at_every_size(spark):
    import math
    m = spark.range(200_000).select(
        F.lit("Latency:api").alias("metric_id"), F.lit("Latency").alias("name"), F.lit("api").alias("dim_value"),
        F.lit(dt.datetime(2026, 1, 1)).cast("timestamp_ntz").alias("ts"),
        (F.pmod(F.xxhash64("id"), F.lit(10_000_000_019)) / 7.0).alias("value"))
    values = sorted(r.value for r in m.collect())
    got = M.window_stats(m).collect()[0]
    assert (got.p50, got.p99) == (values[math.ceil(0.5 * 200_000) - 1], values[math.ceil(0.99 * 200_000) - 1])
    assert (got.samples, got.max) == (200_000, values[-1])


def test_percentiles_of_odd_groups(spark):
    import math
    t = dt.datetime(2026, 1, 1)
    groups = {"one": [5.0], "same": [3.0] * 40, "signs": [-1e9, -2.0, -2.0, 0.0, 0.5, 1e12], "tail": [1.0] * 500 + [1e15] * 4,
              "nulls": [None, 4.0, None, 2.0], "none": [None, None]}
    m = spark.createDataFrame([(g, t, g, "x", v) for g, vs in groups.items() for v in vs],
                              "metric_id string, ts timestamp_ntz, name string, dim_value string, value double")
    for r in M.window_stats(m).collect():
        vs = sorted(v for v in groups[r.name] if v is not None)
        assert r.samples == len(groups[r.name])
        rank = {q: vs[max(math.ceil(q * len(vs)), 1) - 1] if vs else None for q in (0.5, 0.99)}
        assert (r.p50, r.p99, r.max) == (rank[0.5], rank[0.99], vs[-1] if vs else None), r.name


def _rules(spark, *ns):
    return spark.createDataFrame([(f"rule-{n}", "Latency", "api", "max", ">", 3000.0, n) for n in ns], M.RULE_SCHEMA)


def test_rules_carry_their_own_number_of_periods(spark):
    t0 = dt.datetime(2026, 1, 1)
    hot = [0, 1, 2, 3, 4, 5, 7, 8, 9, 11]
    m = spark.createDataFrame([("Latency:api", t0 + dt.timedelta(seconds=300 * p), "Latency", "api", 5000.0 if p in hot else 1.0)
                               for p in range(13) if p != 6], _metrics(spark).schema)
    ev = M.alarm_consecutive(M.evaluate_metrics(m, _rules(spark, 1, 3, 5)))
    got = {}
    for r in ev.filter("in_alarm").collect():
        got.setdefault(r.alarm, set()).add((r.period_start - t0).seconds // 300)
    assert got == {"rule-1": set(hot), "rule-3": {2, 3, 4, 5, 9}, "rule-5": {4, 5}}
    changes = sorted((r.alarm, (r.changed_at - t0).seconds // 300, r.state) for r in M.alarm_transitions(ev).collect())
    assert changes == [("rule-1", 0, "ALARM"), ("rule-1", 6, "OK"), ("rule-1", 7, "ALARM"), ("rule-1", 10, "OK"),
                       ("rule-1", 11, "ALARM"), ("rule-1", 12, "OK"), ("rule-3", 2, "ALARM"), ("rule-3", 6, "OK"),
                       ("rule-3", 9, "ALARM"), ("rule-3", 10, "OK"), ("rule-5", 4, "ALARM"), ("rule-5", 6, "OK")]
    same = M.alarm_consecutive(M.evaluate_rules(M.window_stats(m), _rules(spark, 1, 3, 5)))
    assert sorted(map(str, ev.collect())) == sorted(map(str, same.collect()))
    plan = M.alarm_transitions(same)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def test_stream_and_open_windows_are_all_windows(spark):
    """Closed windows of the stream and open ones together equal the batch, for rules
    of one, three and five periods."""
    m = _metrics(spark)
    rules = _rules(spark, 1, 3, 5)
    base = scratch_path(spark, "test_stream_all")
    m.write.parquet(f"{base}/landing")
    ST.run_consecutive_alarm(spark, f"{base}/landing", m.schema, f"{base}/out", f"{base}/ck", rules=rules)
    cols = ["alarm", "window_end", "breaching_periods", "in_alarm"]
    seen = [tuple(r) for r in ST.closed_windows(spark, f"{base}/out").select(cols).collect()]
    seen += [tuple(r) for r in ST.open_consecutive(m, rules).select(cols).collect()]
    assert len(seen) == len(set(seen))
    by_end = {(a, e): hot for a, e, _, hot in seen}
    for r in M.alarm_consecutive(M.evaluate_rules(M.window_stats(m), rules)).collect():
        assert by_end[r.alarm, r.period_end] == r.in_alarm
    ST.run_tumbling_metrics(spark, f"{base}/landing", m.schema, f"{base}/stats", f"{base}/ck_stats")
    cols = ["metric_id", "period_start", "max", "samples"]
    both = spark.read.parquet(f"{base}/stats").select(cols).union(ST.open_stats(m).select(cols))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, M.window_stats(m).select(cols).collect()))


# --- what statistics and alarms must survive --------------------------------------------

def _points(spark, rows):
    return spark.createDataFrame(rows, "metric_id string, ts timestamp_ntz, name string, dim_value string, value double")


def test_statistics_of_missing_dimensions_infinities_and_nan(spark):
    t, inf, nan = dt.datetime(2026, 1, 1), float("inf"), float("nan")
    groups = {("a", None): [1.0, 2.0, 3.0], (None, "x"): [5.0], ("b", "x"): [-inf, 1.0, inf, inf], ("c", "x"): [nan, 3.0],
              ("d", "x"): [inf], ("e", "x"): [1.7e308, -1.7e308, 4e-320]}
    m = _points(spark, [("m", t, n, d, v) for (n, d), vs in groups.items() for v in vs])
    got = {(r.name, r.dim_value): (r.p50, r.p99, r.samples) for r in M.window_stats(m).collect()}
    assert got[("a", None)] == (2.0, 3.0, 3) and got[(None, "x")] == (5.0, 5.0, 1)
    assert got[("b", "x")] == (1.0, inf, 4) and got[("d", "x")] == (inf, inf, 1)
    assert got[("c", "x")][0] == 3.0 and got[("c", "x")][1] != got[("c", "x")][1]  # NaN ranks above all numbers
    assert got[("e", "x")] == (4e-320, 1.7e308, 3)


def test_longer_windows_are_sums_of_stored_periods(spark):
    m = spark.range(30_000).select(
        F.lit("L:api").alias("metric_id"), F.lit("L").alias("name"), F.when(F.col("id") % 3 > 0, "api").alias("dim_value"),
        F.timestamp_add("SECOND", (F.col("id") * 37).cast("int"), F.lit(dt.datetime(2026, 1, 1))).alias("ts"),
        F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(5000)) / 7.0).alias("value"))
    path = scratch_path(spark, "test_windows")
    M.window_counts(m).write.parquet(path)
    rolled = M.stats_of_counts(M.roll_up(spark.read.parquet(path), 7 * 86400))
    key = lambda r: (r.dim_value or "", r.period_start, r.period_end, round(r.sum, 6), r.max, r.samples, r.p50, r.p99)
    assert sorted(map(key, rolled.collect())) == sorted(map(key, M.window_stats(m, 7 * 86400).collect()))


def test_two_metric_ids_of_one_series_are_one_alarm(spark):
    """A constant breach fires from the third period on, whoever reports the points."""
    t0 = dt.datetime(2026, 1, 1)
    m = _points(spark, [(f"id-{i % 2}", t0 + dt.timedelta(seconds=300 * (i // 2)), "Latency", "api", 9000.0) for i in range(12)])
    rules = spark.createDataFrame([("p99", "Latency", "api", "p99", ">", 3000.0, 3), ("max", "Latency", "api", "max", ">", 3000.0, 3)],
                                  M.RULE_SCHEMA)
    ev = M.alarm_consecutive(M.evaluate_metrics(m, rules)).collect()
    for alarm in ("p99", "max"):
        assert sorted(((r.period_start - t0).seconds // 300, r.in_alarm) for r in ev if r.alarm == alarm) == [
            (i, i >= 2) for i in range(6)]


def test_a_rule_without_dimension(spark):
    m = _points(spark, [("m", dt.datetime(2026, 1, 1), "Depth", None, 5.0), ("m", dt.datetime(2026, 1, 1), "Depth", "q", 1.0)])
    for stat in ("max", "p50"):
        rules = spark.createDataFrame([("deep", "Depth", None, stat, ">=", 5.0, 1)], M.RULE_SCHEMA)
        assert [(r.dim_value, r.breach) for r in M.evaluate_metrics(m, rules).collect()] == [(None, True)]


def test_closed_stream_windows_are_exact_beyond_ten_thousand_points(spark):
    """50,000 points of one window: the exact nearest rank, no sketch."""
    import math
    m = spark.range(50_000).select(
        F.lit("L:api").alias("metric_id"), F.lit("L").alias("name"), F.lit("api").alias("dim_value"),
        F.lit(dt.datetime(2026, 1, 1)).cast("timestamp_ntz").alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(10_000_019)) / 7.0).alias("value"))
    later = m.limit(1).withColumn("ts", F.lit(dt.datetime(2026, 1, 2)).cast("timestamp_ntz"))
    base = scratch_path(spark, "test_stream_exact")
    m.union(later).write.parquet(f"{base}/landing")
    ST.run_tumbling_metrics(spark, f"{base}/landing", m.schema, f"{base}/out", f"{base}/ck")
    values = sorted(r.value for r in m.collect())
    got = spark.read.parquet(f"{base}/out").filter("samples > 1").collect()
    assert [(r.p50, r.p99) for r in got] == [(values[24_999], values[math.ceil(0.99 * 50_000) - 1])]
    assert got[0].period_start == dt.datetime(2026, 1, 1)


def _alarm_feed(spark):
    """Breaches of one series that end in silence while another one goes on."""
    t0 = dt.datetime(2026, 1, 1)
    hot = [0, 1, 2, 3, 4, 5, 7, 8, 9, 11, 20, 21, 22, 23]
    rows = [("Latency:api", t0 + dt.timedelta(seconds=300 * p + 7), "Latency", "api", 5000.0 if p in hot else 1.0)
            for p in range(24) if p not in (6, 15, 16)]
    return _points(spark, rows + [("Other:x", t0 + dt.timedelta(seconds=300 * p), "Other", "x", 1.0) for p in range(40)])


@pytest.mark.parametrize("files_per_trigger", [None, 1])
def test_streamed_state_changes_equal_the_batch(spark, files_per_trigger):
    """All N in one stream, also batch by batch; silence leads to OK."""
    m, rules = _alarm_feed(spark), _rules(spark, 1, 3, 5)
    base = scratch_path(spark, "test_changes")
    m.withColumn("_h", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 2100)).repartitionByRange(6, "_h").drop("_h") \
        .write.parquet(f"{base}/landing")
    run = lambda: ST.run_consecutive_alarm(spark, f"{base}/landing", m.schema, f"{base}/out", f"{base}/ck", rules=rules,
                                           lateness="2 hours", max_files_per_trigger=files_per_trigger)
    run()
    until = dt.datetime(2026, 1, 1) + dt.timedelta(seconds=300 * 39) - dt.timedelta(hours=2)
    last = dt.datetime(2026, 1, 1) + dt.timedelta(seconds=300 * 39)
    ev = M.alarm_consecutive(M.evaluate_metrics(m, rules))
    want = sorted((r.alarm, r.changed_at, r.state) for r in M.alarm_transitions(ev, last=F.lit(last)).collect()
                  if r.changed_at + dt.timedelta(seconds=300) <= until)
    got = sorted((r.alarm, r.changed_at, r.state) for r in ST.state_changes(spark, f"{base}/out").collect())
    assert got == want
    assert ("rule-5", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=300 * 6), "OK") in got
    windows = ST.closed_windows(spark, f"{base}/out")
    cols = ["alarm", "window_start", "window_end", "breaching_periods", "periods_with_data", "in_alarm"]
    all_ = ST.sliding_windows(M.evaluate_rules(M.window_stats(m, 300, M.RULED), rules)).filter(F.col("window_end") <= F.lit(until))
    assert sorted(map(tuple, windows.select(cols).collect())) == sorted(map(tuple, all_.select(cols).collect()))
    # more data: the run goes on from its state, and the silent alarm goes to OK
    more = _points(spark, [("Other:x", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=300 * p), "Other", "x", 1.0) for p in (50, 70)])
    more.write.mode("append").parquet(f"{base}/landing")
    run()
    again = sorted((r.alarm, r.changed_at, r.state) for r in ST.state_changes(spark, f"{base}/out").collect())
    assert set(got) < set(again) and len(again) == len(set(again))
    end = dt.datetime(2026, 1, 1) + dt.timedelta(seconds=300 * 24)
    assert [(a, s) for a, at, s in again if at == end] == [("rule-1", "OK"), ("rule-3", "OK")]


def test_a_replayed_batch_writes_the_same(spark):
    m, rules = _alarm_feed(spark), _rules(spark, 1, 3)
    base = scratch_path(spark, "test_replay")
    alarms = ST.ConsecutiveAlarms(spark, base, rules)
    counts = M.window_counts(m.withColumn("event_time", F.col("ts").cast("timestamp")), group=M.RULED, ts="event_time").persist()
    early = counts.filter("w.end <= timestamp'2026-01-01 00:40:00'")
    late = counts.filter("w.end > timestamp'2026-01-01 00:40:00'")
    alarms(early, 0)
    alarms(late, 1)
    once = sorted(map(str, ST.state_changes(spark, base).collect())), sorted(map(str, ST.closed_windows(spark, base).collect()))
    alarms(late, 1)  # died after its state was published
    alarms(late.limit(0), 2)
    twice = sorted(map(str, ST.state_changes(spark, base).collect())), sorted(map(str, ST.closed_windows(spark, base).collect()))
    assert once == twice
    whole = M.alarm_transitions(M.alarm_consecutive(M.evaluate_metrics(m, rules)))
    assert len(once[0]) >= whole.count()
    state = spark.read.parquet(*versions.latest(spark, f"{base}/state").folders)
    assert state.count() <= 1 + 3  # the last N periods of each rule, no more


def test_a_request_that_cannot_be_scored_fails_alone(spark):
    good = [("2026-01", 4.0), ("2026-02", 6.0)]
    rows = [("ok", good, 2), ("empty", [], 2), ("none", None, 2), ("null", [("2026-01", 1.0), ("2026-02", None)], 2),
            ("nan", [("2026-01", float("nan"))], 2), ("far", good, 99), ("no horizon", good, None), (None, good, 2)]
    requests = spark.createDataFrame(rows, "product_id string, history array<struct<period:string,demand:double>>, horizon int")
    got = FC.score_forecast(requests).collect()
    assert [(r.product_id, r.period) for r in sorted(got, key=lambda r: r.period)] == [("ok", "2026-03"), ("ok", "2026-04")]
    assert all(v == v for r in got for v in (r.lower, r.upper, r.demand))
    assert sorted(str(r.product_id) for r in FC.unscorable(requests).collect()) == sorted(
        ["empty", "none", "null", "nan", "far", "no horizon", "None"])
