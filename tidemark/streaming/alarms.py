"""Structured Streaming twins of the alarm and metric operators.

* ``run_alarm_intake``: JSON event files -> parse -> accept -> ALARM ->
  alerts, critical notifications and dead letters, written by
  ``foreachBatch`` into ``batch_id=<n>`` folders with overwrite, so a batch
  replayed after a failure rewrites the same folder (exactly-once output).  An event
  that is delivered twice counts once.
* ``closed_counts``: watermark + fixed windows, append mode; the state is a count per
  (window, series, value), and a window is emitted once the watermark (max event time -
  lateness) passes its end.  Its statistics are then the batch's own, exact at every size.
* ``run_threshold_alarm`` evaluates the rule table on each batch of closed windows.
* ``run_consecutive_alarm`` follows all rules, of any N, in one stream: sliding windows
  and state changes, from the last N periods of each rule.

State is bounded by the watermark: only windows newer than it are kept.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import vocab
from tidemark.operators import alerts as A
from tidemark.operators import metric_events as ME
from tidemark.operators import metrics as M
from tidemark.sources import events as E
from tidemark.sources import files, versions


DUPLICATES_WITHIN = "1 day"
RETIRE_EVERY = 100  # batches after which old alarm states are dropped


def _run(writer, available_now: bool = True):
    q = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        q.awaitTermination()
    return q


# --- alarm intake --------------------------------------------------------------

def alarm_intake_frames(read: DataFrame, subject_prefix: str = "Critical Alert: ") -> dict[str, DataFrame]:
    """Alerts, notifications, dead letters and metric events of read payloads
    (``events.read_alarm_events``)."""
    good, dead = E.split_alarm_events(read)
    alerts, notes = A.critical_fanout(A.alarm_to_alert(E.accept_alarm_events(good)), subject_prefix)
    dead = dead.select("payload", "error", F.lit(vocab.DEAD_LETTER_RETENTION_DAYS).alias("retention_days"))
    return {"alerts": alerts, "notifications": notes, "dead_letters": dead, "metrics": ME.alerts_created(alerts)}


def run_alarm_intake(spark: SparkSession, source_path: str, out_path: str, checkpoint: str,
                     subject_prefix: str = "Critical Alert: ", available_now: bool = True,
                     max_files_per_trigger: int | None = None, received_at: Column | None = None,
                     duplicates_within: str = DUPLICATES_WITHIN):
    """``received_at`` dates events without a time of their own; by default it is the
    time of the file they came in, which a replay does not change.

    Buses deliver at least once: an event id that comes again within
    ``duplicates_within`` of its first arrival is dropped, across batches and restarts.
    The state is one id per event of that time.  Arrival is the time of the batch, which
    never runs backwards, so no event is late and none is lost by the watermark.  An id
    read from a payload that is no good event does not stand for the event.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    when = F.col("_metadata.file_modification_time") if received_at is None else received_at
    raw = reader.load(source_path).select(F.col("value").alias("payload"), when.alias("received_at"))
    once = (E.read_alarm_events(raw).withColumns({"_good": F.col("error").isNull(), "_arrived": F.current_timestamp()})
            .withWatermark("_arrived", duplicates_within).dropDuplicatesWithinWatermark(["id", "_good"]).drop("_good", "_arrived"))

    def per_batch(df: DataFrame, batch_id: int) -> None:
        read = df.persist()  # parsed once for all four outputs
        try:
            for name, frame in alarm_intake_frames(read, subject_prefix).items():
                target = f"{out_path}/{name}/batch_id={batch_id}"
                if name == "metrics":
                    files.emit_metrics(frame, f"{out_path}/{name}", f"batch-{batch_id}")  # best effort; replay-safe
                else:
                    frame.write.mode("overwrite").parquet(target)
        finally:
            read.unpersist()

    return _run(once.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint), available_now)


# --- metric windows ---------------------------------------------------------------

def metric_stream(spark: SparkSession, source_path: str, schema, lateness: str = vocab.DEFAULT_LATENESS,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    s = reader.parquet(source_path)
    # event time must be TIMESTAMP (not TIMESTAMP_NTZ) for a watermark
    return s.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)


def closed_counts(stream: DataFrame, period_seconds: int = vocab.ALARM_PERIOD_SECONDS,
                  group: tuple[str, ...] = M.SERIES) -> DataFrame:
    """``metrics.window_counts`` of closed windows.  The state is a count per (window,
    group, value): a hot window is spread over all state partitions, and its statistics,
    exact percentiles among them, are made once it is closed (``metrics.stats_of_counts``
    in ``foreachBatch``; all rows of a window leave the state in one batch)."""
    return M.window_counts(stream, period_seconds, group, ts="event_time")


def _closed_stats(counts: DataFrame, group: tuple[str, ...] = M.SERIES) -> DataFrame:
    """The statistics of closed windows, with times as the batch has them."""
    w = F.struct(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"))
    return M.stats_of_counts(counts.withColumn("w", w), group)


def watermark(metrics: DataFrame, lateness: str = vocab.DEFAULT_LATENESS) -> Column:
    """The newest event time less the lateness: windows that end after it are open."""
    return metrics.agg(F.expr(f"max(ts) - INTERVAL {lateness}")).scalar()


def open_stats(metrics: DataFrame, period_seconds: int = vocab.ALARM_PERIOD_SECONDS,
               lateness: str = vocab.DEFAULT_LATENESS, group: tuple[str, ...] = M.SERIES) -> DataFrame:
    """Statistics so far of the windows that a stream over ``metrics`` still holds open.

    A run over a finished folder has no later data to wait for: together with what
    the stream has emitted these are all windows.
    """
    closed_until = watermark(metrics, lateness)
    recent = metrics.filter(F.col("ts") >= closed_until - F.make_dt_interval(secs=F.lit(period_seconds)))
    return M.window_stats(recent, period_seconds, group).filter(F.col("period_end") > closed_until)


def _into_batches(stream: DataFrame, out_path: str, checkpoint: str, available_now: bool, make):
    """Run ``make`` on each batch and write its rows to the batch's own folder, which a
    replay overwrites."""
    def per_batch(df: DataFrame, batch_id: int) -> None:
        make(df).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return _run(stream.writeStream.outputMode("append").foreachBatch(per_batch).option("checkpointLocation", checkpoint),
                available_now)


def run_tumbling_metrics(spark, source_path, schema, out_path, checkpoint, period_seconds=vocab.ALARM_PERIOD_SECONDS,
                         lateness=vocab.DEFAULT_LATENESS, available_now=True, max_files_per_trigger=None):
    counts = closed_counts(metric_stream(spark, source_path, schema, lateness, max_files_per_trigger), period_seconds)
    return _into_batches(counts, out_path, checkpoint, available_now, _closed_stats)


def run_threshold_alarm(spark, source_path, schema, out_path, checkpoint, lateness=vocab.DEFAULT_LATENESS,
                        available_now=True, max_files_per_trigger=None, rules: DataFrame | None = None):
    """Closed windows of each batch -> rule table -> breaches."""
    counts = closed_counts(metric_stream(spark, source_path, schema, lateness, max_files_per_trigger), group=M.RULED)
    rules = M.alarm_rules(spark) if rules is None else rules
    return _into_batches(counts, out_path, checkpoint, available_now,
                         lambda df: M.evaluate_rules(_closed_stats(df, M.RULED), rules).filter(F.col("breach")))


# --- consecutive periods and state changes ---------------------------------------------

EVALUATED = "alarm string, name string, dim_value string, periods int, period_start timestamp_ntz, period_end timestamp_ntz, breach boolean"


def _seconds(n) -> Column:
    return F.make_dt_interval(secs=n)


def sliding_windows(evaluated: DataFrame, period_seconds: int = vocab.ALARM_PERIOD_SECONDS) -> DataFrame:
    """For each rule the windows of its own N periods that hold a period with data:
    breaching periods, periods with data, and ``in_alarm`` where all N breach."""
    back = F.explode(F.sequence(F.lit(0), F.col("periods") - 1)).alias("_back")
    rows = evaluated.select("alarm", "periods", "breach", "period_start", back)
    rows = rows.withColumn("window_start", F.col("period_start") - _seconds(F.col("_back") * period_seconds))
    rows = rows.withColumn("window_end", F.col("window_start") + _seconds(F.col("periods") * period_seconds))
    return (rows.groupBy("alarm", "periods", "window_start", "window_end")
                .agg(F.count_if("breach").alias("breaching_periods"), F.count(F.lit(1)).alias("periods_with_data"))
                .withColumn("in_alarm", F.col("breaching_periods") == F.col("periods")))


class ConsecutiveAlarms:
    """Sliding windows and state changes of all rules, whatever their N, from one stream
    of closed periods.

    What must be known of the past is a rule's last N evaluated periods: that is the
    state, a few rows per alarm.  Each batch reads the state that the batch before it
    left, and publishes its own as a version (``sources/versions.py``) with the batch's
    number, so a replayed batch starts from the same rows and writes the same folders.
    Time goes by closed periods of any series: an alarm whose own series falls silent
    goes to OK as soon as a later period of another one closes, or on ``tick``.
    """

    def __init__(self, spark: SparkSession, out_path: str, rules: DataFrame,
                 period_seconds: int = vocab.ALARM_PERIOD_SECONDS) -> None:
        self.spark, self.path, self.rules, self.period = spark, out_path, rules, period_seconds

    def _before(self, batch_id: int) -> tuple[DataFrame, str | None]:
        """The last periods of each rule and the time up to which all is closed, as the
        batches before ``batch_id`` left them."""
        for version in versions.newest_first(self.spark, f"{self.path}/state"):
            if version.body["batch"] < batch_id:
                return self.spark.read.schema(EVALUATED).parquet(*version.folders), version.body["closed_until"]
        return self.spark.createDataFrame([], EVALUATED), None

    def __call__(self, counts: DataFrame, batch_id: int, now: str | None = None) -> None:
        """One batch of closed counts; ``now``, a time up to which all periods are known
        to be closed, may be later than the last of them."""
        kept, until = self._before(batch_id)
        counts = counts.persist()
        try:
            newest = counts.agg(F.max("w.end").cast("timestamp_ntz").cast("string")).first()[0]
            closed = max(t for t in (until, newest, now, "") if t is not None)
            if not closed or closed == until:
                return
            made = M.evaluate_rules(_closed_stats(counts, M.RULED), self.rules).select(*kept.columns)
            periods = kept.unionByName(made).persist()
            try:
                self._write(periods, until, closed, batch_id)
            finally:
                periods.unpersist()
        finally:
            counts.unpersist()

    def _write(self, periods: DataFrame, until: str | None, closed: str, batch_id: int) -> None:
        end, start = F.lit(closed).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")

        def closes_now(at: Column) -> Column:
            return (at <= end) & (start.isNull() | (at > start))

        windows = sliding_windows(periods, self.period).filter(closes_now(F.col("window_end")))
        windows.write.mode("overwrite").parquet(f"{self.path}/windows/batch_id={batch_id}")
        changes = M.alarm_transitions(M.alarm_consecutive(periods, self.period), self.period, end - _seconds(F.lit(self.period)))
        changes = changes.filter(closes_now(F.col("changed_at") + _seconds(F.lit(self.period))))
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={batch_id}")
        needed = F.col("period_end") > end - _seconds(F.col("periods") * self.period)
        folder = files.write_attempt(periods.filter(needed).coalesce(1), f"{self.path}/state")
        versions.commit(self.spark, f"{self.path}/state", [folder], batch=batch_id, closed_until=closed)
        if batch_id % RETIRE_EVERY == RETIRE_EVERY - 1:
            versions.retire(self.spark, f"{self.path}/state", keep=5, older_than_seconds=3600)

    def tick(self, now: str) -> None:
        """Let time go on to ``now`` without new periods (a query that idles; the end of a
        run): windows and OK changes that only waited for it are written."""
        known = versions.latest(self.spark, f"{self.path}/state")
        nothing = self.spark.createDataFrame([], "name string, dim_value string, w struct<start timestamp, end timestamp>, value double, n long")
        self(nothing, known.body["batch"] + 1 if known else 0, now)


def run_consecutive_alarm(spark, source_path, schema, out_path, checkpoint, lateness=vocab.DEFAULT_LATENESS,
                          available_now=True, max_files_per_trigger=None, rules: DataFrame | None = None):
    """One stream for the rules of every N: ``windows`` (sliding windows of closed
    periods) and ``changes`` (ALARM / OK as they happen) below ``out_path``."""
    rules = M.alarm_rules(spark) if rules is None else rules
    alarms = ConsecutiveAlarms(spark, out_path, rules)
    counts = closed_counts(metric_stream(spark, source_path, schema, lateness, max_files_per_trigger), group=M.RULED)
    query = _run(counts.writeStream.outputMode("append").foreachBatch(alarms).option("checkpointLocation", checkpoint), available_now)
    if available_now and query.lastProgress is not None:
        # the run's last watermark: nothing before it can come any more
        reached = query.lastProgress["eventTime"].get("watermark")
        if reached:
            alarms.tick(reached.replace("T", " ").rstrip("Z"))
    return query


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches; none where no batch wrote any."""
    try:
        return spark.read.schema(schema).parquet(path).drop("batch_id")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def closed_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """The sliding windows that ``run_consecutive_alarm`` has written."""
    return _written(spark, f"{out_path}/windows", "alarm string, periods int, window_start timestamp_ntz, window_end timestamp_ntz, "
                                                  "breaching_periods long, periods_with_data long, in_alarm boolean")


def state_changes(spark: SparkSession, out_path: str) -> DataFrame:
    """The state changes that ``run_consecutive_alarm`` has written."""
    return _written(spark, f"{out_path}/changes", "alarm string, changed_at timestamp_ntz, state string")


def open_consecutive(metrics: DataFrame, rules: DataFrame, period_seconds: int = vocab.ALARM_PERIOD_SECONDS,
                     lateness: str = vocab.DEFAULT_LATENESS) -> DataFrame:
    """The sliding windows that a stream over ``metrics`` still holds open.  Only the
    points of their periods are read, the longest rule's N back from the watermark."""
    until = watermark(metrics, lateness)
    reach = rules.select((F.max("periods") * period_seconds).cast("int").alias("s")).scalar()
    recent = metrics.filter(F.col("ts") >= until - _seconds(reach))
    # whole periods only: the one that the cut runs through ends before any open window starts
    ev = M.evaluate_rules(M.window_stats(recent, period_seconds, M.RULED), rules)
    return sliding_windows(ev, period_seconds).filter(F.col("window_end") > until)
