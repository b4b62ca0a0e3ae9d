"""Record reads: index reads for all keys at once, latest per series, counts, pages.

The services answered one key per request; here one job answers every key.
Unlimited reads are a global sort on (key, sort column): range partitioning
splits a hot key across tasks.  Limited reads use ``row_number() <= n`` so a
partial WindowGroupLimit trims each map task to n rows per key before the
shuffle.
"""

from __future__ import annotations

import base64
import json
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import vocab
from tidemark.functions import scalars as S
from tidemark.session import scratch_path


def newest(ts: str, *ties: str) -> list[Column]:
    """Newest first, missing times last, ties by the given columns."""
    return [F.col(ts).desc_nulls_last(), *[F.col(c) for c in ties]]


def kpi_order() -> list[Column]:
    return newest("ts", "label", "value", "trend")


def series_order() -> list[Column]:
    return newest("ts", "value")


def _restrict(df: DataFrame, key: str, keys: DataFrame | None) -> DataFrame:
    # requested keys as a semi join: AQE broadcasts the key set when it is small
    return df if keys is None else df.join(keys.select(key).distinct(), key, "left_semi")


def index_read(df: DataFrame, key: str, order: list[Column], keys: DataFrame | None = None,
               limit: int | None = None) -> DataFrame:
    """Rows per ``key`` in ``order``; with ``limit`` only the first n per key and
    a 1-based ``pos``."""
    df = _restrict(df, key, keys)
    if limit is None:
        return df.orderBy(F.col(key), *order)
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)


def with_positions(df: DataFrame, key: str | None, order: list[Column]) -> DataFrame:
    """``df`` in the order (key, order) with ``pos``, from 1 within each key.

    The rows are range-sorted and written once to the shared folder with their
    task and place; a key's rows before each task are a prefix sum over
    (key, task) counts.  No window runs over the rows, so a key that holds a
    third of them is numbered by as many tasks as it fills.  ``order`` must
    decide between any two rows that are to have a defined order.
    """
    spark = df.sparkSession
    group = F.lit(0) if key is None else F.col(key)
    path = scratch_path(spark, "ordered_read")
    placed = df.withColumn("_key", group).orderBy("_key", *order)
    placed = placed.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    runs = placed.groupBy("_key", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_key").alias("_run_key"), F.col("_task").alias("_run_task"), "_first",
                       F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.join(runs, F.col("_key").eqNullSafe(F.col("_run_key")) & (F.col("_task") == F.col("_run_task")))
    pos = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return numbered.select(*df.columns, pos.cast("long").alias("pos"))


def scan_index_eq(df: DataFrame, key: str, values, order: list[Column]) -> DataFrame:
    """Index reads: key equal to one of ``values``, ordered.  ``df`` must store the
    key as a column, so that the filter is pushed to the Parquet scan."""
    values = [values] if isinstance(values, str) else list(values)
    return df.filter(F.col(key).isin(*values)).orderBy(F.col(key), *order)


def forecasts_by_product(forecasts: DataFrame, limit: int = vocab.DEFAULT_PAGE_SIZE,
                         products: DataFrame | None = None) -> DataFrame:
    if not 1 <= limit <= vocab.MAX_PAGE_SIZE:
        raise ValueError(f"limit must be between 1 and {vocab.MAX_PAGE_SIZE}")
    return index_read(forecasts, "product_id",
                      [F.col("created_at").desc_nulls_last(), F.col("forecast_id").desc()], products, limit)


def alerts_by_category(alerts: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    return index_read(alerts, "category", [F.col("ts").desc_nulls_last(), F.col("alert_id")], categories)


def inventory_alerts_by_product(inv: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Severity ascending **as text** (critical < high < low < medium), trap T6."""
    return index_read(inv, "product_id", [F.col("severity").asc(), F.col("alert_id")], products)


def kpi_history(kpis: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return index_read(kpis, "kpi_id", kpi_order(), ids)


def metric_series(metrics: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return index_read(metrics, "metric_id", series_order(), ids)


def data_sources_by_type(ds: DataFrame, types: DataFrame | None = None) -> DataFrame:
    return index_read(ds, "source_type", [F.col("source_id")], types)


def insights_by_category(ins: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    return index_read(ins, "category", [F.col("created_at").desc_nulls_last(), F.col("insight_id")], categories)


def access_by_role(acl: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    return index_read(acl, "role", [F.col("user_id")], roles)


def governance_series(gov: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return index_read(gov, "metric_id", series_order(), ids)


def bias_by_model(bias: DataFrame, components: DataFrame | None = None) -> DataFrame:
    return index_read(bias, "model_component", [F.col("detected_at").desc_nulls_last(), F.col("detection_id")], components)


def latest_per_key(df: DataFrame, key: str, ts: str, tie: list[str] | None = None) -> DataFrame:
    """Newest row per key; a missing ts loses to any present one.

    ``row_number() == 1`` -> partial WindowGroupLimit before the shuffle, so
    a key with a third of all rows costs one row per map task.
    """
    order = [F.col(ts).desc_nulls_last()] + [F.col(c).desc_nulls_last() for c in (tie or [])]
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_kpi_per_series(kpis: DataFrame) -> DataFrame:
    """Dashboard view: latest row per kpi_id, sorted by kpi_id."""
    return latest_per_key(kpis, "kpi_id", "ts", ["label", "value", "trend"]).orderBy("kpi_id")


def sort_newest_first(df: DataFrame, ts: str, key: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(key))


def list_count(df: DataFrame, group: str | None = None) -> DataFrame:
    """The list envelope's ``count`` (per index value when grouped)."""
    if group is None:
        return df.agg(F.count(F.lit(1)).alias("count"))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("count"))


def unacknowledged(col: str = "acknowledged") -> Column:
    """Missing acknowledgement counts as not acknowledged."""
    return ~F.coalesce(F.col(col), F.lit(False))


def alerts_unacknowledged_count(alerts: DataFrame, group: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("count"), F.count_if(unacknowledged()).alias("unacknowledged")]
    return alerts.agg(*aggs) if group is None else alerts.groupBy(group).agg(*aggs)


def filter_unacknowledged(alerts: DataFrame) -> DataFrame:
    return alerts.filter(unacknowledged())


def critical_inventory_count(inv: DataFrame) -> DataFrame:
    return inv.agg(F.count_if(F.col("severity") == "critical").alias("critical_count"))


class InvalidPageToken(ValueError):
    """The text is not the token of a page of this table."""


@dataclass(frozen=True)
class PageCursor:
    """Where a page ends in the order (key, null keys last, rest of the row): the last
    row's key as text with its type, the hash of its other columns, and how many rows of
    the page are equal to it."""
    column: str
    type: str
    value: str | None
    rest: int
    equal: int

    def token(self) -> str:
        return base64.urlsafe_b64encode(json.dumps(astuple(self)).encode()).decode()

    @classmethod
    def parse(cls, token: str, df: DataFrame, key: str) -> PageCursor:
        """The cursor of a token for ``df`` by ``key``; raises InvalidPageToken."""
        try:
            cursor = cls(*json.loads(base64.b64decode(token, altchars=b"-_", validate=True)))
            fits = (cursor.column, cursor.type) == (key, df.schema[key].dataType.simpleString())
            whole = isinstance(cursor.rest, int) and isinstance(cursor.equal, int) and isinstance(cursor.value, str | None)
        except (ValueError, TypeError) as exc:
            raise InvalidPageToken("not a page token") from exc
        if not fits or not whole:
            raise InvalidPageToken(f"not the token of a page by {key}")
        return cursor

    def from_here(self) -> Column:
        """Rows at the cursor or after it; a filter on the key that the scan can use."""
        key, rest = F.col(self.column), F.col(_REST)
        if self.value is None:
            return key.isNull() & (rest >= self.rest)
        at = F.lit(self.value).cast(self.type)
        return key.isNull() | (key > at) | ((key == at) & (rest >= self.rest))


_REST = "_rest_of_row"
_CURSOR_TYPES = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")


@dataclass(frozen=True)
class Page:
    items: DataFrame
    next_token: str | None


def page_order(key: str) -> Column:
    return F.col(key).asc_nulls_last()


def page_keyset(df: DataFrame, key: str, page_size: int, token: str | None = None) -> Page:
    """One page: the ``page_size`` rows after the token's cursor, and the token of the
    next page if there is one.

    The order is by ``key``, rows without a key last; rows that share a key (it is meant
    to be unique) follow the hash of their other columns, so no row is lost at a border.
    A page is a top-k (partial top-k per task, then a merge) over a range filter that
    reaches the scan; only the page's keys reach the driver.
    """
    if not 1 <= page_size <= vocab.MAX_PAGE_SIZE:
        raise ValueError(f"limit must be between 1 and {vocab.MAX_PAGE_SIZE}")
    kind = df.schema[key].dataType.simpleString()
    if not kind.startswith(_CURSOR_TYPES):
        raise TypeError(f"a page key cannot be of type {kind}")
    cursor = PageCursor.parse(token, df, key) if token else None
    rest = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(c) for c in df.columns if c != key])))
    rows, skip = df.withColumn(_REST, rest), 0
    if cursor is not None:
        rows, skip = rows.filter(cursor.from_here()), cursor.equal
    rows = rows.orderBy(page_order(key), _REST).limit(skip + page_size + 1)
    ends = rows.select(F.col(key).cast("string"), _REST).collect()  # a page's keys and those it starts after
    here = ends[skip:skip + page_size]
    items = rows.limit(skip + page_size)
    if skip:  # rows equal to the cursor's: the first are on the page before
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(page_order(key), _REST))
        items = items.withColumn("_place", place).filter(F.col("_place") > skip).drop("_place")
    next_token = None
    if len(ends) > skip + page_size:
        equal = sum(1 for r in ends[:skip + page_size] if r == here[-1])
        next_token = PageCursor(key, kind, here[-1][0], here[-1][1], equal).token()
    return Page(items.drop(_REST), next_token)


def paged(df: DataFrame, key: str, page_size: int) -> DataFrame:
    """Every row with the number of its page, from 1.  One range sort and a prefix sum
    number all pages at once; none is walked to."""
    if "page" in df.columns:
        raise ValueError("the rows have a column page already")
    placed = with_positions(df, None, [page_order(key)])
    return placed.withColumn("page", F.floor((F.col("pos") - 1) / page_size + 1).cast("long")).drop("pos")


def page_directory(df: DataFrame, key: str, page_size: int) -> DataFrame:
    """One row per page of the table: page, first_key, last_key (null keys come last),
    n_rows and has_next.  The page that holds a key, or that follows a cursor, is found
    here by its border keys."""
    pages = paged(df.select(key), key, page_size)
    last_page = pages.agg(F.max("page")).scalar()
    present = F.max(key).alias("_max")
    borders = pages.groupBy("page").agg(F.min(key).alias("first_key"), present, F.count_if(F.col(key).isNull()).alias("_nulls"),
                                        F.count(F.lit(1)).alias("n_rows"))
    return borders.select("page", "first_key", F.when(F.col("_nulls") == 0, F.col("_max")).alias("last_key"), "n_rows",
                          (F.col("page") < last_page).alias("has_next"))


def top_alerts(inv: DataFrame, n: int = 3) -> DataFrame:
    """First n by operational severity, then key (global top-k, no full sort)."""
    return (inv.withColumn("severity_rank", S.severity_rank("severity"))
               .orderBy("severity_rank", "alert_id").limit(n))


def get_by_key(table: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Batch single-record fetch: every requested key with ``found``."""
    # table rows for requested keys only (table streamed through a semi join),
    # then the request batch keeps its own rows with a left join
    hits = table.join(requests.select(key).distinct(), key, "left_semi")
    out = requests.join(hits.withColumn("_found", F.lit(True)), key, "left")
    return out.withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found")


def ttl_retention(df: DataFrame, as_of_epoch: int | Column, ttl: str = "ttl") -> DataFrame:
    """Drop rows whose ttl (epoch seconds) has passed; rows without ttl stay."""
    cut = F.lit(as_of_epoch) if isinstance(as_of_epoch, int) else as_of_epoch
    return df.filter(F.col(ttl).isNull() | (F.col(ttl) > cut))
