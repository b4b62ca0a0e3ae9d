"""Publishing by partition and aggregates per partition."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import forecast as FC
from tidemark.plans.forecast_queries import refresh_demand
from tidemark.session import scratch_path
from tidemark.sources import files, parts, versions


def sales(spark, extra=(), without=()):
    rows = [(f"p{i % 4}", dt.datetime(2026, 1 + i % 6, 1 + i % 20), i % 7 + 1, 2026, 1 + i % 6) for i in range(240)]
    rows = [r for r in rows if r[4] not in without] + list(extra)
    return spark.createDataFrame(rows, "product_id string, order_date timestamp, quantity int, year int, month int")


def test_unchanged_partitions_keep_their_folders(spark):
    path = scratch_path(spark, "parts")
    one = parts.publish_parts(sales(spark), path, ("year", "month"))
    two = parts.publish_parts(sales(spark).repartition(7), path, ("year", "month"))  # the same rows in other files
    assert two.folders == one.folders and parts.changed_parts(one, two) == set()
    late = ("p9", dt.datetime(2026, 3, 30), 5, 2026, 3)
    three = parts.publish_parts(sales(spark, [late], without=(6,)), path, ("year", "month"))
    assert parts.changed_parts(two, three) == {"year=2026/month=3"}
    assert set(two.body["parts"]) - set(three.body["parts"]) == {"year=2026/month=6"}
    key = lambda df: sorted(map(str, df.select("product_id", "order_date", "quantity", "year", "month").collect()))
    assert key(parts.read_parts(spark, three)) == key(sales(spark, [late], without=(6,)))
    assert key(parts.read_parts(spark, one)) == key(sales(spark))  # the old version is whole
    again = parts.publish_parts(sales(spark, [late, late], without=(6,)), path, ("year", "month"))  # a repeated row counts
    assert parts.changed_parts(three, again) == {"year=2026/month=3"}


def test_only_changed_months_are_aggregated_again(spark):
    curated, demand = scratch_path(spark, "parts"), scratch_path(spark, "demand")
    seen = []

    def make(rows):
        seen.append({(r.year, r.month) for r in rows.select("year", "month").distinct().collect()})
        return refresh_demand(rows)

    def full(df):
        return sorted(map(tuple, FC.monthly_demand(df).select("product_id", "period", "demand").collect()))

    def kept():
        held = parts.read_parts(spark, versions.latest(spark, demand))
        return sorted(map(tuple, held.select("product_id", "period", "demand").collect()))

    late = ("p9", dt.datetime(2026, 3, 30), 5, 2026, 3)
    for df in (sales(spark), sales(spark, [late]), sales(spark, [late]), sales(spark, [late], without=(6,))):
        parts.publish_parts(df, curated, ("year", "month"))
        parts.refresh(spark, curated, demand, ("year", "month"), make)
        assert kept() == full(df)
    assert seen == [{(2026, m) for m in range(1, 7)}, {(2026, 3)}]  # the third run changed nothing, the last only dropped
    number = versions.latest(spark, demand).number
    parts.refresh(spark, curated, demand, ("year", "month"), make)
    assert versions.latest(spark, demand).number == number


def test_a_refresh_that_dies_changes_nothing(spark):
    import pytest
    curated, demand = scratch_path(spark, "parts"), scratch_path(spark, "demand")
    parts.publish_parts(sales(spark), curated, ("year", "month"))
    parts.refresh(spark, curated, demand, ("year", "month"), refresh_demand)
    before = versions.latest(spark, demand)
    parts.publish_parts(sales(spark, [("p9", dt.datetime(2026, 3, 30), 5, 2026, 3)]), curated, ("year", "month"))
    with pytest.raises(Exception, match="died"):
        parts.refresh(spark, curated, demand, ("year", "month"),
                      lambda rows: refresh_demand(rows).withColumn("demand", F.raise_error(F.lit("died")).cast("long")))
    assert versions.latest(spark, demand).number == before.number
    assert files.read_snapshot(spark, curated) is not None
    parts.refresh(spark, curated, demand, ("year", "month"), refresh_demand)
    assert versions.latest(spark, demand).number == before.number + 1
