"""Input views over the driver tables, built with the DataFrame API.

The driver's tables are clean; these views add deterministic dirt and the
record tables of the platform so that every operator reads data whose size
grows with the scale factor.  ``tidemark.plans.oracle_views`` states the
same views in DuckDB SQL for the correctness oracle; the two must stay in step.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import vocab
from tidemark.functions import scalars as S
from tidemark.sources.tables import read_table

# --- fixed values of the views (shared with oracle_views) --------------------
ALARM_NAME_BY_EVENT = (
    ("error", "critical-inventory-stockout"),
    ("click", "demand-forecast-drift"),
    ("view", "supplier-sla-breach"),
    ("signup", "unauthorized-access-attempt"),
    ("purchase", "cpu-high"),
)
ALARM_STATES = ("OK", "INSUFFICIENT_DATA", "ALARM", "ALARM")
ERROR_FUNCTIONS = ("forecasts", "alerts", "data-platform", "optimization", "analytics", "governance")
# event_type -> (metric name, dimension name, dimension value or None for by-user, unit, scale)
METRIC_BY_EVENT = (
    ("error", "Errors", "FunctionName", None, "Count", 1.0),
    ("view", "Latency", "ApiName", "api", "Milliseconds", 20.0),
    ("click", "5XXError", "ApiName", "api", "Count", 1.0),
    ("signup", "ApproximateNumberOfMessagesVisible", "QueueName", "lambda-dlq", "Count", 1.0),
    ("purchase", "Count", "ApiName", "api", "Count", 1.0),
)
BACKTEST_CUTOFF = "2001-01"  # the two accuracy queries forecast from the months before
FORECAST_AS_OF = _dt.datetime(2002, 1, 1)
FORECAST_RUNS = 60  # nightly runs in forecast_runs, the last at FORECAST_AS_OF
FORECAST_HORIZON = 6
BASELINE_MODEL_VERSION = "baseline-quantile-v1"
EPOCH = _dt.datetime(2024, 1, 1)
UNKNOWN_PERMISSION = "audit_logs"
MODEL_COMPONENTS = ("demand-model", "pricing-model", "routing-model", "supplier-model")
BIAS_TYPES = ("seasonal", "regional", "channel")
BIAS_STATUSES = ("detected", "mitigating", "resolved")
INSIGHT_CATEGORIES = ("demand", "inventory", "supplier", "logistics")
SCENARIO_STATUSES = ("draft", "completed", "failed")


def pick(values, idx: Column) -> Column:
    """values[idx mod n] from a literal list."""
    return F.element_at(S.lit_array(values), ((idx % len(values)) + 1).cast("int"))


def ts_plus_minutes(base: _dt.datetime, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, F.lit(base).cast("timestamp_ntz"))


def _epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


# --- V1 sales_raw -------------------------------------------------------------

SALES_ORDER = "_l_orderkey"  # the order of a row of ``sales_by_order``, by which its join deals rows out


def sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_by_order(spark, sf_dir).drop(SALES_ORDER)


def sales_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales_raw`` with SALES_ORDER, which an order_id decides."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_quantity", "l_extendedprice", "l_shipdate"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority"])
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    pk = F.col("l_partkey")
    return j.select(
        F.when(pk % 101 == 0, F.lit(None).cast("string")).otherwise(F.col("l_orderkey").cast("string")).alias("order_id"),
        pk.cast("string").alias("product_id"),
        F.col("o_orderdate").cast("timestamp").alias("order_date"),
        F.when(pk % 53 == 0, F.lit(None).cast("int")).when(pk % 59 == 0, F.lit(0))
         .otherwise(F.col("l_quantity").cast("int")).alias("quantity"),
        F.when(pk % 61 == 0, F.lit("n/a"))
         .otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("unit_price"),
        F.col("l_suppkey").cast("string").alias("warehouse_id"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("channel"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("timestamp"))
         .otherwise(F.col("l_shipdate").cast("timestamp")).alias("ingested_at"),
        F.col("l_orderkey").alias(SALES_ORDER),
    )


# --- V2 metrics / V3 kpis (events) ---------------------------------------------

def _events(spark, sf_dir, cols=("event_id", "ts", "user_id", "event_type", "value")):
    return read_table(spark, sf_dir, "events", list(cols))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    name = dim_name = dim_value = unit = scale = None
    for ev, mname, dname, dval, u, sc in METRIC_BY_EVENT:
        is_ev = F.col("event_type") == ev
        dv = F.lit(dval) if dval is not None else pick(ERROR_FUNCTIONS, F.col("user_id"))
        name = F.when(is_ev, F.lit(mname)) if name is None else name.when(is_ev, F.lit(mname))
        dim_name = F.when(is_ev, F.lit(dname)) if dim_name is None else dim_name.when(is_ev, F.lit(dname))
        dim_value = F.when(is_ev, dv) if dim_value is None else dim_value.when(is_ev, dv)
        unit = F.when(is_ev, F.lit(u)) if unit is None else unit.when(is_ev, F.lit(u))
        scale = F.when(is_ev, F.lit(sc)) if scale is None else scale.when(is_ev, F.lit(sc))
    return e.select(
        F.concat(name, F.lit(":"), dim_value).alias("metric_id"),
        F.col("ts"),
        name.alias("name"),
        dim_name.alias("dim_name"),
        dim_value.alias("dim_value"),
        (F.col("value") * scale).alias("value"),
        unit.alias("unit"),
        (_epoch_seconds(F.col("ts")) + 7 * 86400).alias("ttl"),
    )


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(
        F.concat(F.lit("kpi-"), F.col("event_type"), F.lit("-"), (F.col("user_id") % 20).cast("string")).alias("kpi_id"),
        F.col("ts"),
        F.col("event_type").alias("label"),
        F.col("value").cast("decimal(10,2)").cast("string").alias("value"),
        F.when(F.col("value") >= 50, "up").otherwise("down").alias("trend"),
        (_epoch_seconds(F.col("ts")) + 30 * 86400).alias("ttl"),
    )


# --- V4 alarm events / V5 alerts -----------------------------------------------

def alarm_events_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    name = None
    for ev, alarm in ALARM_NAME_BY_EVENT:
        is_ev = F.col("event_type") == ev
        name = F.when(is_ev, F.lit(alarm)) if name is None else name.when(is_ev, F.lit(alarm))
    return e.select(
        "event_id", "ts",
        F.when(F.col("user_id") % 10 == 0, F.lit("custom.app")).otherwise(F.lit(vocab.ALARM_EVENT_SOURCE)).alias("source"),
        F.lit(vocab.ALARM_EVENT_DETAIL_TYPE).alias("detail_type"),
        F.concat(F.lit("region-"), (F.col("user_id") % 3).cast("string")).alias("region"),
        F.lpad(F.col("user_id").cast("string"), 12, "0").alias("account"),
        name.alias("alarm_name"),
        pick(ALARM_STATES, F.col("event_id")).alias("state"),
        F.concat(F.lit("value "), F.col("value").cast("decimal(10,2)").cast("string")).alias("reason"),
    )


def alarm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, received_at, payload): JSON text as the event bus delivers it.

    Ids are UUID-shaped text; every 79th event has none.  Every 89th has no time,
    every 83rd one that cannot be read.  Every 97th payload is cut short.  The last
    two kinds must land in the dead-letter table.
    """
    f = alarm_events_flat(spark, sf_dir)
    k = F.col("event_id")
    time = F.when(k % 83 == 0, F.lit("yesterday")).when(k % 89 != 0, S.iso_utc(F.col("ts")))
    payload = F.to_json(F.struct(
        F.when(k % 79 != 0, S.stable_id("", k)).alias("id"),
        F.col("source"),
        F.col("detail_type").alias("detail-type"),
        F.col("region"),
        F.col("account"),
        time.alias("time"),
        F.struct(F.col("alarm_name").alias("alarmName"),
                 F.struct(F.col("state").alias("value"), F.col("reason").alias("reason")).alias("state")
                 ).alias("detail"),
    ))
    payload = F.when(k % 97 == 0, F.substring(payload, 1, 40)).otherwise(payload)
    return f.select("event_id", "ts", F.col("ts").alias("received_at"), payload.alias("payload"))


def event_key(event_id: Column, payload: Column) -> Column:
    """The id under which an event of ``alarm_events`` is known."""
    return F.when(event_id % 79 != 0, S.stable_id("", event_id)).otherwise(S.stable_id("ev-", payload))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import alerts as A
    from tidemark.sources import events as E
    parsed, _dead = E.parse_alarm_events(alarm_events(spark, sf_dir))
    al = A.alarm_to_alert(E.accept_alarm_events(parsed))
    # acknowledged: a third each of missing, false and true, by a hash of the id
    h = F.conv(F.substring(F.md5(F.col("alert_id")), 1, 6), 16, 10).cast("long") % 3
    return al.withColumn("acknowledged", F.when(h == 0, F.lit(None).cast("boolean")).otherwise(h == 1))


# --- V6 demand history / V7 forecasts ------------------------------------------

def curated_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import etl
    return etl.curate(sales_by_order(spark, sf_dir), (SALES_ORDER,))


def demand_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import forecast
    return forecast.monthly_demand(curated_sales(spark, sf_dir))


def forecasts(spark: SparkSession, sf_dir: str, demand: DataFrame | None = None) -> DataFrame:
    """Baseline forecasts from the whole history, horizon 6, made at FORECAST_AS_OF.
    ``demand`` is the demand history where a job has stored it."""
    from tidemark.operators import forecast
    demand = demand_history(spark, sf_dir) if demand is None else demand
    preds = forecast.baseline_quantiles(demand, horizon=FORECAST_HORIZON)
    pid = F.col("product_id").cast("long")  # for a third of the products the model states an accuracy
    preds = preds.withColumn("accuracy", F.when(pid % 3 == 0, (pid % 10 + 90).cast("double")))
    return forecast.forecast_record(preds, FORECAST_AS_OF, BASELINE_MODEL_VERSION)


def forecast_id(product: Column) -> Column:
    """The id of a product's record in ``forecasts``."""
    as_of = F.lit(FORECAST_AS_OF).cast("timestamp_ntz")
    return S.stable_id("fc-", product, as_of, F.lit(BASELINE_MODEL_VERSION))


def forecast_runs(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """Forecast records of the last FORECAST_RUNS nightly runs, newest at FORECAST_AS_OF.
    ``records`` are the ``forecasts`` where a job has stored them."""
    latest = (forecasts(spark, sf_dir) if records is None else records).drop("forecast_id", "created_at")
    back = F.explode(F.sequence(F.lit(0), F.lit(FORECAST_RUNS - 1))).alias("_back")
    runs = latest.select("*", back).withColumn(
        "created_at", F.timestamp_add("DAY", -F.col("_back"), F.lit(FORECAST_AS_OF).cast("timestamp_ntz"))).drop("_back")
    return runs.withColumn("forecast_id", S.stable_id("fc-", "product_id", "created_at", "model_version"))


# --- V8 inventory alerts, V11 optimisations (part) ------------------------------

def inventory_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"])
    qty = (F.col("p_size") * 37) % 500
    return p.select(
        F.concat(F.lit("ia-"), F.col("p_partkey").cast("string")).alias("alert_id"),
        F.concat(F.lit("p-"), (F.col("p_partkey") % 500).cast("string")).alias("product_id"),
        F.col("p_name").alias("product"),
        F.when(qty < 200, "reorder").when(qty > 400, "overstock").otherwise("optimal").alias("status"),
        qty.alias("quantity"),
        F.lit(200).alias("threshold"),
        pick(("critical", "high", "medium", "low"), F.col("p_size")).alias("severity"),
        (F.col("p_partkey") % 7 == 0).alias("acknowledged"),
        ts_plus_minutes(EPOCH, F.col("p_partkey")).alias("created_at"),
    )


def optimizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    status = pick(vocab.OPTIMIZATION_STATUSES, F.col("p_partkey"))
    created = ts_plus_minutes(_dt.datetime(2024, 2, 1), F.col("p_partkey"))
    return p.select(
        F.concat(F.lit("opt-"), F.col("p_partkey").cast("string")).alias("optimization_id"),
        F.concat(F.lit("p-"), (F.col("p_partkey") % 500).cast("string")).alias("product_id"),
        F.concat(F.lit("set level to "), (F.col("p_size") * 3 + 200).cast("string")).alias("recommendation"),
        ((F.col("p_size") * 37) % 500).alias("current_level"),
        (F.col("p_size") * 3 + 200).alias("recommended_level"),
        (F.col("p_size") * 125).cast("long").alias("projected_savings"),
        status.alias("status"),
        created.alias("created_at"),
        F.when(status == "applied", F.timestamp_add("DAY", F.lit(1), created)).alias("applied_at"),
    )


# --- V9 data sources, scenarios (supplier) --------------------------------------

def data_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    return s.select(
        F.concat(F.lit("ds-"), F.col("s_suppkey").cast("string")).alias("source_id"),
        F.col("s_name").alias("name"),
        pick(vocab.SOURCE_TYPES, F.col("s_suppkey")).alias("source_type"),
        pick(vocab.SOURCE_STATUSES, F.col("s_nationkey")).alias("status"),
        ts_plus_minutes(EPOCH, F.col("s_suppkey")).alias("last_sync"),
        (F.col("s_suppkey") * 1000).alias("records_processed"),
        (F.lit(90.0) + (F.col("s_suppkey") % 100) / 10.0).alias("data_quality"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey"])
    return s.select(
        F.concat(F.lit("sc-"), F.col("s_suppkey").cast("string")).alias("scenario_id"),
        F.concat(F.lit("Scenario "), F.col("s_suppkey").cast("string")).alias("name"),
        pick(vocab.SCENARIO_TYPES, F.col("s_suppkey")).alias("scenario_type"),
        pick(SCENARIO_STATUSES, F.col("s_suppkey")).alias("status"),
        F.lit(None).cast("string").alias("last_run_id"),
        F.lit(None).cast("timestamp_ntz").alias("last_run_at"),
        ts_plus_minutes(EPOCH, F.col("s_suppkey")).alias("updated_at"),
    )


# --- V10 access controls (customer) ---------------------------------------------

def access_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    k = F.col("c_custkey")
    w1 = pick(vocab.KNOWN_PERMISSIONS, k)
    w2 = pick(vocab.KNOWN_PERMISSIONS, k * 7 + 3)
    w3 = pick(vocab.KNOWN_PERMISSIONS, k * 5 + 1)
    perms = (F.when(k % 10 == 0, F.array(w1, w2, F.lit(UNKNOWN_PERMISSION), w1))
             .when(k % 3 == 0, F.array(w1, w2, w3))
             .otherwise(F.array(w1, w2)))
    return c.select(
        F.concat(F.lit("u-"), k.cast("string")).alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("role"),
        F.concat(F.lit("dept-"), (F.col("c_nationkey") % 5).cast("string")).alias("department"),
        perms.alias("permissions"),
        F.when(F.col("c_acctbal") < 0, "suspended").otherwise("active").alias("status"),
        ts_plus_minutes(EPOCH, k).alias("last_access"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


# --- V12 reports, insights (orders); governance, bias (events) -------------------

def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("rpt-"), k.cast("string")).alias("report_id"),
        F.concat(F.lit("Order report "), k.cast("string")).alias("title"),
        pick(vocab.REPORT_TYPES, k).alias("report_type"),
        F.lit("generating").alias("status"),
        F.when(k % 11 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("o_orderdate")).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("generated_at"),
        F.lit(None).cast("string").alias("object_key"),
    )


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("in-"), k.cast("string")).alias("insight_id"),
        pick(INSIGHT_CATEGORIES, F.col("o_custkey")).alias("category"),
        F.concat(F.lit("Insight "), k.cast("string")).alias("title"),
        pick(vocab.SEVERITIES, k).alias("impact"),
        F.timestamp_add("SECOND", k, F.col("o_orderdate")).alias("created_at"),
    )


def governance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(
        F.concat(F.lit("gov-"), F.col("event_type")).alias("metric_id"),
        F.col("ts"),
        F.concat(F.col("event_type"), F.lit(" check")).alias("name"),
        F.col("value"),
        F.lit(100.0).alias("threshold"),
        F.when(F.col("value") > 150, "violation").when(F.col("value") > 100, "warning")
         .otherwise("compliant").alias("status"),
    )


def bias_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(
        F.concat(F.lit("bd-"), F.col("event_id").cast("string")).alias("detection_id"),
        pick(MODEL_COMPONENTS, F.col("user_id")).alias("model_component"),
        pick(BIAS_TYPES, F.col("event_id")).alias("bias_type"),
        pick(vocab.SEVERITIES, F.col("event_id") + F.col("user_id")).alias("severity"),
        pick(BIAS_STATUSES, F.col("user_id") + 1).alias("status"),
        F.col("ts").alias("detected_at"),
    )


# --- request tables for the batched record jobs ----------------------------------

def alert_ack_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = alarm_events(spark, sf_dir)
    eid = F.col("event_id")
    key = F.when(eid % 50 == 7, F.concat(F.lit("al-missing-"), eid.cast("string"))) \
           .otherwise(F.concat(F.lit("al-"), event_key(eid, F.col("payload"))))
    return (e.filter((eid % 3 == 1) | (eid % 50 == 7))
             .select(key.alias("alert_id"), F.timestamp_add("HOUR", F.lit(1), F.col("ts")).alias("requested_at")))


def inventory_ack_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey"])
    k = F.col("p_partkey")
    key = F.when(k % 37 == 0, F.concat(F.lit("ia-missing-"), k.cast("string"))) \
           .otherwise(F.concat(F.lit("ia-"), k.cast("string")))
    return (p.filter((k % 5 == 0) | (k % 37 == 0))
             .select(key.alias("alert_id"), ts_plus_minutes(_dt.datetime(2024, 6, 1), k).alias("requested_at")))


def forecast_status_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey"])
    k = F.col("p_partkey")
    return (p.filter(k % 4 != 3)
             .select(forecast_id(k.cast("string")).alias("forecast_id"),
                     pick(("superseded", "archived", "bogus"), k % 4).alias("status"),
                     ts_plus_minutes(_dt.datetime(2001, 7, 1), k).alias("requested_at")))


# Several requests per key, some at equal times; keys that are unknown or missing;
# and one hot key per table.

def _requests(df: DataFrame, k: Column, most: int, prefix: str, key: str, hot: str) -> DataFrame:
    """1 to ``most`` requests per row: k, i, request_id and the key they name."""
    rows = df.withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") % most)))
    text, i = F.col("k").cast("string"), F.col("i")
    named = (F.when((F.col("k") % 13 == 5) & (i == 0), F.lit(None).cast("string"))
             .when(F.col("k") % 17 == 0, F.concat(F.lit(f"{prefix}missing-"), text))
             .when((F.col("k") % 4 == 3) & (i == 1), F.lit(hot))
             .otherwise(F.concat(F.lit(prefix), text)))
    return rows.select("*", named.alias(key), F.concat_ws("-", F.lit("rq"), text, i.cast("string")).alias("request_id"))


def source_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey"])
    r = _requests(s, F.col("s_suppkey"), 5, "ds-", "source_id", "ds-1")
    k, i = F.col("k"), F.col("i")
    kind = (k + i) % 6
    patch = (F.when(kind == 0, F.create_map(F.lit("status"), F.lit("error"),
                                            F.lit("records_processed"), (k * 1000 + 500 + i).cast("string")))
             .when(kind == 1, F.create_map(F.lit("status"), F.lit("paused")))
             .when(kind == 2, F.create_map(F.lit("owner"), F.lit("ops")))
             .when(kind == 3, F.create_map(F.lit("name"), F.concat(F.lit("renamed "), F.col("request_id")),
                                           F.lit("owner"), F.lit("ops")))
             .when(kind == 4, F.create_map(F.lit("data_quality"), F.lit("97.5"), F.lit("status"), F.lit("idle")))
             .otherwise(F.create_map(F.lit("records_processed"), F.lit("lots"))))
    return r.select("source_id", "request_id", patch.alias("patch"),
                    ts_plus_minutes(_dt.datetime(2024, 3, 1), F.floor((k + i) / 2)).alias("requested_at"))


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey"])
    r = _requests(c.filter(F.col("c_custkey") % 2 == 0), F.col("c_custkey"), 5, "u-", "user_id", "u-1")
    k, i = F.col("k"), F.col("i")
    a = pick(vocab.KNOWN_PERMISSIONS, k * 3 + i)
    b = pick(vocab.KNOWN_PERMISSIONS, k + 5)
    perms = F.when((k + i) % 20 == 0, F.array(a, F.lit("root_access"), b)).otherwise(F.array(b, a))
    return r.select("user_id", "request_id", perms.alias("permissions"),
                    F.concat(F.lit("admin-"), (k % 4).cast("string"), F.lit("@example.com")).alias("actor"),
                    ts_plus_minutes(_dt.datetime(2024, 4, 1), F.floor((k + i) / 2)).alias("requested_at"))


def report_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    r = _requests(o.filter(F.col("o_orderkey") % 3 == 0), F.col("o_orderkey"), 4, "rpt-", "report_id", "rpt-1")
    later = F.timestamp_add("HOUR", F.lit(24) + F.floor(F.col("i") / 2), F.col("o_orderdate"))
    return r.select("report_id", "request_id", later.alias("requested_at"))


def scenario_run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("sc-"), (k % 150).cast("string")).alias("scenario_id"),
                    S.stable_id("run-", k).alias("run_id"),
                    F.timestamp_add("SECOND", k, F.col("o_orderdate")).alias("requested_at"))


def apply_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey"])
    r = _requests(p.filter(F.col("p_partkey") % 2 == 1), F.col("p_partkey"), 5, "opt-", "optimization_id", "opt-3")
    return r.select("optimization_id", "request_id",
                    ts_plus_minutes(_dt.datetime(2024, 5, 1), F.floor((F.col("k") + F.col("i")) / 2)).alias("requested_at"))


def alert_create_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, ("event_id", "ts", "event_type"))
    eid = F.col("event_id")
    return e.select(
        F.concat(F.lit("req-"), eid.cast("string")).alias("request_id"),
        F.when(eid % 13 == 0, F.lit(None).cast("string"))
         .when(eid % 13 == 1, F.lit("")).otherwise(F.concat(F.lit("Event "), eid.cast("string"))).alias("title"),
        pick(("info", "warning", "critical", None, "panic"), eid).alias("alert_type"),
        F.when(eid % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("category"),
        F.when(eid % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("message "), eid.cast("string"))).alias("message"),
        F.when(eid % 7 == 0, F.lit("ERP")).otherwise(F.lit(None).cast("string")).alias("source"),
        F.when(eid % 4 == 0, F.lit(None).cast("boolean")).otherwise(eid % 4 == 1).alias("action_required"),
        F.when(eid % 6 == 0, F.create_map(F.lit("origin"), F.col("event_type"))).alias("metadata"),
        F.col("ts").alias("requested_at"),
    )


def inference_requests(spark: SparkSession, sf_dir: str, demand: DataFrame | None = None) -> DataFrame:
    """One request per product: its whole monthly history, a horizon in 0..29;
    every 17th product sends an empty history, every 19th no demand for its last month.
    ``demand`` is the demand history where a job has stored it."""
    from tidemark.operators import forecast
    hist = forecast.collect_history(demand_history(spark, sf_dir) if demand is None else demand)
    pid = F.col("product_id").cast("long")
    empty = F.filter(F.col("history"), lambda x: F.lit(False))
    last = F.size("history") - 1
    gap = F.transform("history", lambda x, i: F.struct(x["period"].alias("period"),
                                                       F.when(i != last, x["demand"]).alias("demand")))
    return hist.select(
        "product_id",
        F.when(pid % 17 == 0, empty).when(pid % 19 == 0, gap).otherwise(F.col("history")).alias("history"),
        (pid % 30).cast("int").alias("horizon"),
    )
