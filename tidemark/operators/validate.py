"""Batch request validation: each request row gets a status code and an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidemark import vocab


def is_missing(col: str, dtype: T.DataType | None = None) -> Column:
    """Missing = null, "" or [] (0 and false count as present)."""
    c = F.col(col)
    if isinstance(dtype, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(dtype, T.ArrayType):
        return c.isNull() | (F.size(c) == 0)
    if dtype is None:
        return c.isNull() | (c.cast("string") == "")
    return c.isNull()


def missing_fields(fields: list[str], schema: T.StructType | None = None) -> Column:
    """Array of the required field names that are missing, in the given order."""
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    return F.array_compact(F.array(*[F.when(is_missing(f, types.get(f, T.StringType())), F.lit(f)) for f in fields]))


def validate_required(df: DataFrame, fields: list[str]) -> DataFrame:
    miss = missing_fields(fields, df.schema)
    return (df.withColumn("missing", F.array_join(miss, ", "))
              .withColumn("status_code", F.when(F.size(miss) > 0, F.lit(400)).otherwise(F.lit(200))))


def validate_enum(df: DataFrame, col: str, allowed: tuple[str, ...]) -> DataFrame:
    ok = F.coalesce(F.col(col).isin(*allowed), F.lit(False))
    return (df.withColumn("status_code", F.when(ok, F.lit(200)).otherwise(F.lit(400)))
              .withColumn("error", F.when(~ok, F.lit(f"{col} must be one of: {', '.join(allowed)}"))))


def validate_page_size(df: DataFrame, col: str = "limit") -> DataFrame:
    """Text page size -> int in 1..200 (default 50), else 400."""
    n = F.coalesce(F.trim(F.col(col)).try_cast("int"), F.when(F.col(col).isNull(), F.lit(vocab.DEFAULT_PAGE_SIZE)))
    ok = F.coalesce(n.between(1, vocab.MAX_PAGE_SIZE), F.lit(False))
    return (df.withColumn("page_size", F.when(ok, n))
              .withColumn("status_code", F.when(ok, F.lit(200)).otherwise(F.lit(400))))


def validate_inference_request(df: DataFrame) -> DataFrame:
    """product_id present; history a non-empty array whose points all have a demand;
    horizon integer 1..24 (default 6)."""
    # truncate toward zero first, as int() does, then check the range
    h = F.coalesce(F.col("horizon"), F.lit(vocab.DEFAULT_FORECAST_HORIZON)).try_cast("int")
    err = (F.when(is_missing("product_id", T.StringType()), F.lit("Missing required field(s): productId"))
            .when(F.col("history").isNull() | (F.size(F.col("history")) == 0),
                  F.lit("historicalData must be a non-empty array"))
            .when(F.exists("history", lambda x: x.isNull() | x["demand"].isNull()),
                  F.lit("historicalData points must have a demand"))
            .when(~F.coalesce(h.between(1, vocab.MAX_FORECAST_HORIZON), F.lit(False)),
                  F.lit(f"forecastHorizon must be an integer between 1 and {vocab.MAX_FORECAST_HORIZON}")))
    return (df.withColumn("horizon", h)
              .withColumn("error", err)
              .withColumn("status_code", F.when(err.isNull(), F.lit(200)).otherwise(F.lit(400))))


def whitelist_update_fields(patch: str | Column, allowed: tuple[str, ...] = vocab.MUTABLE_SOURCE_FIELDS) -> Column:
    """Keep only the mutable keys of a patch map."""
    p = F.col(patch) if isinstance(patch, str) else patch
    allowed_arr = F.array(*[F.lit(a) for a in allowed])
    return F.map_filter(p, lambda k, v: F.array_contains(allowed_arr, k))
