"""Alarm state-change events: JSON text -> typed rows, with a dead-letter split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark import vocab
from tidemark.functions import scalars as S

ALARM_EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("detail-type", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("account", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("detail", T.StructType([
        T.StructField("alarmName", T.StringType()),
        T.StructField("state", T.StructType([
            T.StructField("value", T.StringType()),
            T.StructField("reason", T.StringType()),
        ])),
    ])),
    T.StructField("_corrupt", T.StringType()),
])


def parse_event_json(df: DataFrame, text_col: str = "payload",
                     schema: T.StructType = ALARM_EVENT_SCHEMA) -> DataFrame:
    """Add ``event`` (parsed struct) and ``parse_ok``.

    A payload that is not JSON, not an object, or does not fit the declared
    types is marked ``parse_ok = false`` (never an exception).
    """
    parsed = F.from_json(F.col(text_col), schema,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # Parse inside a generator: filters on the parsed fields cannot be pushed
    # below a Generate, so each payload is parsed once instead of once per
    # predicate (from_json falls back from codegen, and a pushed-down filter
    # would repeat it for every conjunct).
    out = df.select("*", F.inline(F.array(F.struct(parsed.alias("event")))))
    ok = F.col("event").isNotNull() & F.col("event._corrupt").isNull() & F.trim(F.col(text_col)).startswith("{")
    return out.withColumn("parse_ok", F.coalesce(ok, F.lit(False)))


BAD_PAYLOAD = "payload is not a valid alarm event object"
BAD_TIME = "event time cannot be read"


def read_alarm_events(raw: DataFrame, text_col: str = "payload") -> DataFrame:
    """One flat row per payload with ``error``, null for a good event.

    ``id`` is the event's own text id, or a hash of the payload where it has none.
    ``event_time`` is the event's time (UTC, as sessions run in UTC); an event without
    a time gets ``received_at`` when ``raw`` has that column, else the current time.
    A time that is there but cannot be read is an error.  No payload stops the job.
    """
    p = parse_event_json(raw, text_col)
    received = F.col("received_at") if "received_at" in raw.columns else F.current_timestamp()
    given = F.col("event.time")
    time = F.try_to_timestamp(given).cast("timestamp_ntz")
    keep = [c for c in raw.columns if c != "received_at"]
    return p.select(
        *keep,
        F.coalesce(F.col("event.id"), S.stable_id("ev-", text_col)).alias("id"),
        F.col("event.source").alias("source"),
        F.col("event.`detail-type`").alias("detail_type"),
        F.col("event.region").alias("region"),
        F.col("event.account").alias("account"),
        F.col("event.detail.alarmName").alias("alarm_name"),
        F.col("event.detail.state.value").alias("state"),
        F.col("event.detail.state.reason").alias("reason"),
        F.when(given.isNull(), received.cast("timestamp_ntz")).otherwise(time).alias("event_time"),
        F.when(~F.col("parse_ok"), F.lit(BAD_PAYLOAD))
         .when(given.isNotNull() & time.isNull(), F.lit(BAD_TIME)).alias("error"))


def split_alarm_events(read: DataFrame, text_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good flat rows, dead letters with their payload and error) of read events."""
    flat = ("id", "source", "detail_type", "region", "account", "alarm_name", "state", "reason", "event_time")
    return (read.filter(F.col("error").isNull()).drop(text_col, "error"),
            read.filter(F.col("error").isNotNull()).drop(*flat))


def parse_alarm_events(raw: DataFrame, text_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Split JSON events into (good flat rows, dead letters)."""
    return split_alarm_events(read_alarm_events(raw, text_col), text_col)


def accept_alarm_events(flat: DataFrame) -> DataFrame:
    """Event-bus rule: only alarm state changes from the monitoring source."""
    return flat.filter((F.col("source") == vocab.ALARM_EVENT_SOURCE)
                       & (F.col("detail_type") == vocab.ALARM_EVENT_DETAIL_TYPE))


def filter_alarm_state(flat: DataFrame) -> DataFrame:
    """Only ALARM goes on; a missing state is ignored (null-safe)."""
    return flat.filter(F.coalesce(F.col("state") == vocab.ALARM_STATE, F.lit(False)))


def dead_letters(dead: DataFrame, as_of_col: str = "ts",
                 retention_days: int = vocab.DEAD_LETTER_RETENTION_DAYS, as_of=None) -> DataFrame:
    """Dead-letter rows with their expiry; with ``as_of`` (a timestamp) rows
    already past retention are dropped."""
    out = dead.withColumn("expires_at", F.timestamp_add("DAY", F.lit(retention_days), F.col(as_of_col)))
    if as_of is not None:
        out = out.filter(F.col("expires_at") > F.lit(as_of))
    return out


def read_alarm_events_json(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of a folder of JSON-lines event files, one payload per line."""
    return spark.read.text(path).withColumnRenamed("value", "payload")
