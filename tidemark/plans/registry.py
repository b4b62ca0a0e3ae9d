"""Query registry: one entry per operator ID of SURVEY §2.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the input views; the
matching oracle is DuckDB SQL over the driver's tables (views inlined as
CTEs).  Queries with a sink write their output under the shared checkpoint
folder and return the read-back frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(qid: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if qid in QUERIES:
            raise ValueError(f"duplicate query id {qid}")
        QUERIES[qid] = fn
        if sql is not None:
            ORACLE[qid] = with_views(views, sql)
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from tidemark.plans import (alert_queries, etl_queries, forecast_queries,  # noqa: F401
                                metric_queries, record_queries, stream_queries, update_queries)


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
