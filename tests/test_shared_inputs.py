"""Work that jobs on the sales share: one deal of the rows by order, demand made once."""

import datetime as dt
from decimal import Decimal

import pytest

from tidemark.operators import etl
from tidemark.plans import forecast_queries, metric_queries
from tidemark.plans import views as V

DAY = dt.datetime(2001, 5, 3)


@pytest.fixture()
def sales_dir(spark, tmp_path):
    """Orders with repeated keys and lines that repeat (order, product)."""
    orders = [(k, DAY + dt.timedelta(days=31 * (k % 3)), "1-URGENT" if k % 2 else "4-NOT SPECIFIED") for k in range(1, 30)]
    orders.append((5, DAY, "5-LOW"))
    lines = [(k, p, s, n, Decimal(q), Decimal(100 + q), DAY + dt.timedelta(days=40 * n))
             for k in range(1, 30) for n, (p, s, q) in enumerate([(7, 1, 3), (7, 2, 4), (101, 1, 5), (8 + k % 3, 1, 6)], 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity decimal(12,2), "
                                 "l_extendedprice decimal(12,2), l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows(df):
    return sorted(map(str, df.collect()))


def test_joined_sales_are_not_dealt_out_again_for_the_latest_row(spark, sales_dir, no_broadcast):
    curated = V.curated_sales(spark, sales_dir)
    plan = curated._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 2  # the two sides of the join
    assert rows(curated) == rows(etl.curate(V.sales_raw(spark, sales_dir)))


def test_rows_dealt_by_month_are_the_curated_rows(spark, sales_dir):
    raw = V.sales_by_order(spark, sales_dir)
    dealt = etl.curate(raw, (V.SALES_ORDER,), dealt=True)
    plain = etl.curate(V.sales_raw(spark, sales_dir))
    assert dealt.schema == plain.schema and rows(dealt) == rows(plain)
    assert rows(forecast_queries.monthly_demand_refreshed(spark, sales_dir)) == rows(forecast_queries.monthly_demand(spark, sales_dir))


def test_metric_events_make_the_demand_once(spark, sales_dir, monkeypatch):
    """The sites that report on forecasts and requests read one stored demand history."""
    made, real = [], V.demand_history
    monkeypatch.setattr(V, "demand_history", lambda *a: made.append(1) or real(*a))
    for name in ("alerts", "scenarios", "scenario_run_requests", "optimizations", "apply_requests", "access_controls", "access_requests"):
        monkeypatch.setattr(V, name, lambda *a: None)
    empty = lambda *a: None
    monkeypatch.setattr(metric_queries.U, "report_generate", lambda *a: (None, None))
    monkeypatch.setattr(metric_queries.U, "scenario_run_record", lambda *a: (None, None))
    monkeypatch.setattr(metric_queries.U, "apply_if_proposed", lambda *a: (None, None))
    monkeypatch.setattr(metric_queries.U, "access_replace", lambda *a: (None, None, None))
    monkeypatch.setattr(V, "reports", empty)
    monkeypatch.setattr(V, "report_requests", empty)
    none = metric_queries.ME.forecast_generated(spark.createDataFrame([], "forecast_id string"))
    for name in ("alerts_created", "optimization_run_started", "optimization_applied", "report_generated", "access_control_changed"):
        monkeypatch.setattr(metric_queries.ME, name, lambda df: none)
    events = metric_queries.metric_events(spark, sales_dir)
    assert len(made) == 1
    assert "lineitem" not in events._jdf.queryExecution().executedPlan().toString()
    names = {r["metric_name"] for r in events.collect()}
    assert {"ForecastsRetrieved", "ForecastGenerated", "DirectInference"} <= names
