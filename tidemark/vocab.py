"""Fixed values the results depend on.

These are the closed vocabularies, defaults and limits of the platform whose
behaviour this package reproduces.  They are stated here once, in their
natural order; operators import them and never restate them.
"""

# --- fixed values: alerts ---------------------------------------------------
ALERT_TYPES = ("info", "warning", "critical")
# Category rules are tried in this order; the first category with a keyword
# contained in the lower-cased alarm name wins, otherwise "system".
CATEGORY_KEYWORDS = (
    ("inventory", ("inventory", "stock")),
    ("demand", ("demand", "forecast")),
    ("supply", ("supply", "supplier")),
    ("security", ("security", "access")),
)
DEFAULT_CATEGORY = "system"
DEFAULT_ALERT_TYPE = "info"
DEFAULT_ALERT_SOURCE = "System"
DEFAULT_ALARM_NAME = "unknown-alarm"
ALARM_TITLE_PREFIX = "CloudWatch Alarm: "
ALARM_DEFAULT_REASON = "Alarm threshold breached"
ALARM_SOURCE_LABEL = "AWS CloudWatch"
ALARM_EVENT_SOURCE = "aws.cloudwatch"
ALARM_EVENT_DETAIL_TYPE = "CloudWatch Alarm State Change"
ALARM_STATE = "ALARM"
NOTIFY_SUBJECT_MAX = 100
SEVERITIES = ("low", "medium", "high", "critical")
SEVERITY_RANK = (("critical", 0), ("high", 1), ("medium", 2), ("low", 3))

# --- fixed values: forecasts ------------------------------------------------
FORECAST_STATUSES = ("active", "superseded", "archived")
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200
DEFAULT_FORECAST_HORIZON = 6
MAX_FORECAST_HORIZON = 24
CONTEXT_LENGTH = 96
QUANTILES = (0.1, 0.5, 0.9)
DEFAULT_MODEL_VERSION = "unknown"

# --- fixed values: data platform --------------------------------------------
SOURCE_TYPES = ("S3", "Kinesis", "RDS", "API")
SOURCE_STATUSES = ("active", "processing", "error", "idle")
MUTABLE_SOURCE_FIELDS = ("status", "last_sync", "records_processed", "data_quality", "name")
PROCESSED_TODAY_SHARE = 0.05

# --- fixed values: governance -----------------------------------------------
KNOWN_PERMISSIONS = (
    "view_forecasts",
    "manage_inventory",
    "generate_reports",
    "model_training",
    "data_access",
    "algorithm_tuning",
    "executive_dashboard",
    "strategic_reports",
    "budget_approval",
    "manage_users",
    "acknowledge_alerts",
    "run_optimizations",
)

# --- fixed values: optimisation / reports -----------------------------------
OPTIMIZATION_STATUSES = ("proposed", "applied", "dismissed")
SCENARIO_TYPES = ("route", "warehouse", "inventory", "cost")
REPORT_TYPES = ("operational", "executive", "compliance")
DEFAULT_REPORT_TYPE = "operational"

# --- fixed values: ETL ------------------------------------------------------
DEFAULT_CHANNEL = "unknown"
ETL_METRIC_NAMES = ("RowsRead", "RowsCurated", "RowsQuarantined")

# --- fixed values: metric alarms --------------------------------------------
# (alarm, metric, dimension value, statistic, comparison, threshold, periods)
# Period is 300 s for all; missing data counts as not breaching.
ALARM_PERIOD_SECONDS = 300
ALARM_RULES = (
    ("critical-forecasts-errors", "Errors", "forecasts", "sum", ">=", 1.0, 1),
    ("critical-alerts-errors", "Errors", "alerts", "sum", ">=", 1.0, 1),
    ("data-platform-errors", "Errors", "data-platform", "sum", ">=", 1.0, 1),
    ("optimization-errors", "Errors", "optimization", "sum", ">=", 1.0, 1),
    ("analytics-errors", "Errors", "analytics", "sum", ">=", 1.0, 1),
    ("critical-governance-errors", "Errors", "governance", "sum", ">=", 1.0, 1),
    ("critical-dlq-depth", "ApproximateNumberOfMessagesVisible", "lambda-dlq", "max", ">=", 1.0, 1),
    ("critical-api-5xx", "5XXError", "api", "sum", ">", 5.0, 1),
    ("api-latency-p99", "Latency", "api", "p99", ">", 3000.0, 3),
)
DEFAULT_LATENESS = "10 minutes"
DEAD_LETTER_RETENTION_DAYS = 14
