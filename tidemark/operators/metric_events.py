"""The business metric events that the record jobs emit, one row per event.

Each function stands for one emission site of the services and takes the frame that
the job has anyway.  Columns: namespace, metric_name, value, unit, dimensions,
source_key (what the event is about, so that a replay can be told from a new event).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import vocab
from tidemark.operators.metrics import dims_text


def _event(df: DataFrame, namespace: str, name: str, key: Column, value: Column | None = None, unit: str = "Count",
           dimensions: Column | None = None) -> DataFrame:
    return df.select(F.lit(namespace).alias("namespace"), F.lit(name).alias("metric_name"),
                     (F.lit(1.0) if value is None else value.cast("double")).alias("value"), F.lit(unit).alias("unit"),
                     (F.lit("") if dimensions is None else dimensions).alias("dimensions"), key.alias("source_key"))


def alerts_created(alerts: DataFrame) -> DataFrame:
    return _event(alerts, "Alerts", "AlertsCreated", F.col("alert_id"),
                  dimensions=dims_text(("AlertType", F.col("alert_type")), ("Category", F.col("category"))))


def forecasts_retrieved(pages: DataFrame) -> DataFrame:
    """Per product read: how many forecasts it returned."""
    return _event(pages.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n")), "API", "ForecastsRetrieved",
                  F.col("product_id"), F.col("_n"))


def forecast_generated(records: DataFrame) -> DataFrame:
    return _event(records, "ML", "ForecastGenerated", F.col("forecast_id"))


def forecast_accuracy(records: DataFrame) -> DataFrame:
    """Only for records whose model states an accuracy."""
    return _event(records.filter(F.col("accuracy").isNotNull()), "ML", "ForecastAccuracy", F.col("forecast_id"),
                  F.col("accuracy"), "Percent")


def direct_inference(valid_requests: DataFrame) -> DataFrame:
    return _event(valid_requests, "ML", "DirectInference", F.col("product_id"))


def optimization_run_started(run_records: DataFrame) -> DataFrame:
    started = run_records.filter(F.col("status_code") == 200)
    return _event(started, "Operations", "OptimizationRunStarted", F.col("run_id"),
                  dimensions=dims_text(("Status", F.col("run_status"))))


def optimization_applied(outcomes: DataFrame) -> DataFrame:
    return _event(outcomes.filter(F.col("outcome") == "applied"), "Operations", "OptimizationApplied",
                  F.col("optimization_id"))


def report_generated(artifacts: DataFrame) -> DataFrame:
    kind = F.coalesce(F.get_json_object("artifact", "$.reportType"), F.lit(vocab.DEFAULT_REPORT_TYPE))
    return _event(artifacts, "Operations", "ReportGenerated", F.col("object_key"), dimensions=dims_text(("ReportType", kind)))


def access_control_changed(audit: DataFrame) -> DataFrame:
    return _event(audit, "Governance", "AccessControlChanged", F.col("subject"))
