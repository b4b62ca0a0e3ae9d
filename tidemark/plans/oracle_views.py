"""The input views of ``tidemark.plans.views`` stated in DuckDB SQL.

Used only by the correctness oracle (``oracle_sql()``): every oracle query is
``WITH <views it needs> SELECT ...`` over the driver's pre-registered tables.
Literal lists come from the same fixed values as the Spark views.
"""

from __future__ import annotations

from tidemark import vocab
from tidemark.plans import views as V


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]"


def pick(values, idx: str) -> str:
    return f"({sql_list(values)})[(({idx}) % {len(values)}) + 1]"


def ts_plus_minutes(base, minutes: str) -> str:
    return f"(TIMESTAMP '{base:%Y-%m-%d %H:%M:%S}' + to_minutes(CAST({minutes} AS BIGINT)))"


def epoch_s(ts: str) -> str:
    return f"CAST(floor(epoch({ts})) AS BIGINT)"


def category_sql(name: str) -> str:
    parts = []
    for cat, kws in vocab.CATEGORY_KEYWORDS:
        cond = " OR ".join(f"contains(lower({name}), {q(k)})" for k in kws)
        parts.append(f"WHEN {cond} THEN {q(cat)}")
    return f"(CASE {' '.join(parts)} ELSE {q(vocab.DEFAULT_CATEGORY)} END)"


def severity_sql(name: str) -> str:
    return f"(CASE WHEN contains(lower({name}), 'critical') THEN 'critical' ELSE 'warning' END)"


def severity_rank_sql(col: str) -> str:
    whens = " ".join(f"WHEN {col} = {q(s)} THEN {r}" for s, r in vocab.SEVERITY_RANK)
    return f"(CASE {whens} ELSE {len(vocab.SEVERITY_RANK)} END)"


def stable_id_sql(prefix: str, key: str) -> str:
    h = f"md5(CAST({key} AS VARCHAR))"
    return (f"({q(prefix)} || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4)"
            f" || '-' || substr({h},17,4) || '-' || substr({h},21,12))")


def iso_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def next_period_sql(last: str, i: str) -> str:
    """Month ``i`` after ``last`` with the operator's parsing rule."""
    parts = f"string_split(coalesce({last}, ''), '-')"
    y_txt, m_txt = f"{parts}[1]", f"{parts}[2]"
    ok = (f"(len({parts}) >= 2 AND regexp_full_match({y_txt}, '\\s*\\+?[0-9]+\\s*')"
          f" AND regexp_full_match({m_txt}, '\\s*\\+?[0-9]+\\s*'))")
    base = f"(TRY_CAST(trim({y_txt}) AS INTEGER) * 12 + least(TRY_CAST(trim({m_txt}) AS INTEGER), 12) - 1 + ({i}))"
    dated = (f"printf('%04d-%02d', CAST(floor({base} / 12) AS BIGINT), "
             f"CAST({base} - floor({base} / 12) * 12 + 1 AS BIGINT))")
    return f"(CASE WHEN {ok} THEN {dated} ELSE 't+' || CAST({i} AS VARCHAR) END)"


def _metric_case(field: int, default_dim: str | None = None) -> str:
    whens = []
    for row in V.METRIC_BY_EVENT:
        ev = row[0]
        val = row[field]
        if field == 3 and val is None:
            expr = pick(V.ERROR_FUNCTIONS, "user_id")
        elif isinstance(val, float):
            expr = repr(val)
        else:
            expr = q(val)
        whens.append(f"WHEN event_type = {q(ev)} THEN {expr}")
    return f"(CASE {' '.join(whens)} END)"


def _alarm_name_case() -> str:
    return "(CASE " + " ".join(f"WHEN event_type = {q(e)} THEN {q(a)}" for e, a in V.ALARM_NAME_BY_EVENT) + " END)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


cte("sales_raw", (), f"""
SELECT CASE WHEN l.l_partkey % 101 = 0 THEN NULL ELSE CAST(l.l_orderkey AS VARCHAR) END AS order_id,
       CAST(l.l_partkey AS VARCHAR) AS product_id,
       o.o_orderdate AS order_date,
       CASE WHEN l.l_partkey % 53 = 0 THEN NULL WHEN l.l_partkey % 59 = 0 THEN 0
            ELSE CAST(l.l_quantity AS INTEGER) END AS quantity,
       CASE WHEN l.l_partkey % 61 = 0 THEN 'n/a'
            ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS unit_price,
       CAST(l.l_suppkey AS VARCHAR) AS warehouse_id,
       CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o.o_orderpriority END AS channel,
       CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_shipdate END AS ingested_at
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")

cte("classified", ("sales_raw",), """
SELECT *, COALESCE(order_id IS NOT NULL AND product_id IS NOT NULL AND order_date IS NOT NULL
                   AND quantity > 0 AND price IS NOT NULL, FALSE) AS is_valid
FROM (SELECT *, TRY_CAST(unit_price AS DECIMAL(12,2)) AS price FROM sales_raw) t""")

cte("deduped", ("classified",), """
SELECT * EXCLUDE (newest) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, product_id
        ORDER BY ingested_at DESC NULLS LAST, price DESC NULLS LAST,
                 quantity DESC NULLS LAST, warehouse_id DESC NULLS LAST) AS newest
  FROM classified WHERE is_valid) t WHERE newest = 1""")

cte("curated", ("deduped",), f"""
SELECT order_id, product_id, order_date, quantity, price AS unit_price,
       CAST(quantity * price AS DECIMAL(23,2)) AS line_total, warehouse_id,
       COALESCE(channel, {q(vocab.DEFAULT_CHANNEL)}) AS channel,
       CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month
FROM deduped""")

cte("quarantine", ("classified",), """
SELECT * EXCLUDE (is_valid),
  array_to_string(list_filter([
     CASE WHEN order_id IS NULL THEN 'missing_order_id' END,
     CASE WHEN product_id IS NULL THEN 'missing_product_id' END,
     CASE WHEN order_date IS NULL THEN 'missing_order_date' END,
     CASE WHEN NOT COALESCE(quantity > 0, FALSE) THEN 'bad_quantity' END,
     CASE WHEN price IS NULL THEN 'bad_unit_price' END], lambda x: x IS NOT NULL), ',') AS reject_reason
FROM classified WHERE NOT is_valid""")

cte("demand_history", ("curated",), """
SELECT product_id, strftime(order_date, '%Y-%m') AS period, CAST(SUM(quantity) AS BIGINT) AS demand
FROM curated GROUP BY product_id, strftime(order_date, '%Y-%m')""")

def forecast_id_sql(product: str, created: str | None = None) -> str:
    created = f"strftime({created}, '%Y-%m-%d %H:%M:%S')" if created else q(f"{V.FORECAST_AS_OF:%Y-%m-%d %H:%M:%S}")
    return stable_id_sql("fc-", f"({product} || '|' || {created} || '|' || {q(V.BASELINE_MODEL_VERSION)})")


_AS_OF = f"TIMESTAMP '{V.FORECAST_AS_OF:%Y-%m-%d %H:%M:%S}'"

cte("forecasts", ("fc_preds",), f"""
SELECT {forecast_id_sql('product_id')} AS forecast_id, product_id, {_AS_OF} AS created_at,
       CAST(0.8 AS DOUBLE) AS confidence, {q(V.BASELINE_MODEL_VERSION)} AS model_version, 'active' AS status,
       CASE WHEN CAST(product_id AS BIGINT) % 3 = 0 THEN CAST(CAST(product_id AS BIGINT) % 10 + 90 AS DOUBLE) END AS accuracy
FROM fc_preds GROUP BY product_id""")

cte("forecast_runs", ("forecasts",), f"""
SELECT {forecast_id_sql('product_id', 'created_at')} AS forecast_id, product_id, created_at
FROM (SELECT product_id, {_AS_OF} - to_days(CAST(unnest(generate_series(0, {V.FORECAST_RUNS - 1})) AS INTEGER)) AS created_at
      FROM forecasts) r""")

cte("metrics", (), f"""
SELECT name || ':' || dim_value AS metric_id, ts, name, dim_name, dim_value, value * scale AS value, unit,
       {epoch_s('ts')} + 604800 AS ttl
FROM (SELECT ts, value, {_metric_case(1)} AS name, {_metric_case(2)} AS dim_name, {_metric_case(3)} AS dim_value,
             {_metric_case(4)} AS unit, {_metric_case(5)} AS scale FROM events) e""")

cte("kpis", (), f"""
SELECT 'kpi-' || event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS kpi_id, ts, event_type AS label,
       CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS value,
       CASE WHEN value >= 50 THEN 'up' ELSE 'down' END AS trend, {epoch_s('ts')} + 2592000 AS ttl
FROM events""")

cte("alarm_flat", (), f"""
SELECT event_id, ts,
       CASE WHEN user_id % 10 = 0 THEN 'custom.app' ELSE {q(vocab.ALARM_EVENT_SOURCE)} END AS source,
       {q(vocab.ALARM_EVENT_DETAIL_TYPE)} AS detail_type,
       'region-' || CAST(user_id % 3 AS VARCHAR) AS region,
       lpad(CAST(user_id AS VARCHAR), 12, '0') AS account,
       {_alarm_name_case()} AS alarm_name,
       {pick(V.ALARM_STATES, 'event_id')} AS state,
       'value ' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS reason,
       event_id % 97 <> 0 AS json_ok, event_id % 97 <> 0 AND event_id % 83 <> 0 AS parse_ok, event_id % 89 <> 0 AS has_time,
       CASE WHEN event_id % 89 <> 0 THEN date_trunc('second', ts) ELSE ts END AS event_time
FROM events""")

cte("alarm_keyed", ("alarm_flat",), f"""
SELECT *, CASE WHEN event_id % 79 <> 0 THEN {stable_id_sql('', 'event_id')} ELSE {stable_id_sql('ev-', "CASE WHEN event_id % 97 = 0 THEN substr(payload, 1, 40) ELSE payload END")} END AS id
FROM (SELECT *, '{{' || CASE WHEN event_id % 79 <> 0 THEN '"id":"' || {stable_id_sql('', 'event_id')} || '",' ELSE '' END
          || '"source":"' || source || '","detail-type":"' || detail_type || '","region":"' || region || '","account":"'
          || account || '",' || CASE WHEN event_id % 83 = 0 THEN '"time":"yesterday",'
                                     WHEN event_id % 89 <> 0 THEN '"time":"' || {iso_sql('ts')} || '",' ELSE '' END
          || '"detail":{{"alarmName":"' || alarm_name || '","state":{{"value":"' || state || '","reason":"' || reason
          || '"}}}}}}' AS payload FROM alarm_flat) f""")

cte("alerts", ("alarm_keyed",), f"""
SELECT *, CASE WHEN h = 0 THEN NULL ELSE h = 1 END AS acknowledged
FROM (SELECT *, CAST(('0x' || substr(md5(alert_id), 1, 6)) AS BIGINT) % 3 AS h FROM (
SELECT 'al-' || id AS alert_id, has_time,
       {severity_sql('alarm_name')} AS alert_type, {category_sql('alarm_name')} AS category,
       {q(vocab.ALARM_TITLE_PREFIX)} || alarm_name AS title, reason AS message, event_time AS ts,
       {q(vocab.ALARM_SOURCE_LABEL)} AS source,
       CAST(NULL AS TIMESTAMP) AS acknowledged_at, TRUE AS action_required,
       alarm_name AS meta_alarm_name, region AS meta_region, account AS meta_account_id
FROM alarm_keyed
WHERE parse_ok AND source = {q(vocab.ALARM_EVENT_SOURCE)} AND detail_type = {q(vocab.ALARM_EVENT_DETAIL_TYPE)}
  AND state = 'ALARM') a) b""")

cte("inventory_alerts", (), f"""
SELECT 'ia-' || CAST(p_partkey AS VARCHAR) AS alert_id, 'p-' || CAST(p_partkey % 500 AS VARCHAR) AS product_id,
       p_name AS product,
       CASE WHEN (p_size * 37) % 500 < 200 THEN 'reorder' WHEN (p_size * 37) % 500 > 400 THEN 'overstock'
            ELSE 'optimal' END AS status,
       (p_size * 37) % 500 AS quantity, 200 AS threshold,
       {pick(('critical', 'high', 'medium', 'low'), 'p_size')} AS severity,
       p_partkey % 7 = 0 AS acknowledged, {ts_plus_minutes(V.EPOCH, 'p_partkey')} AS created_at
FROM part""")

cte("optimizations", (), f"""
SELECT 'opt-' || CAST(p_partkey AS VARCHAR) AS optimization_id, 'p-' || CAST(p_partkey % 500 AS VARCHAR) AS product_id,
       'set level to ' || CAST(p_size * 3 + 200 AS VARCHAR) AS recommendation,
       (p_size * 37) % 500 AS current_level, p_size * 3 + 200 AS recommended_level,
       CAST(p_size * 125 AS BIGINT) AS projected_savings,
       {pick(vocab.OPTIMIZATION_STATUSES, 'p_partkey')} AS status,
       {ts_plus_minutes(__import__('datetime').datetime(2024, 2, 1), 'p_partkey')} AS created_at,
       CASE WHEN {pick(vocab.OPTIMIZATION_STATUSES, 'p_partkey')} = 'applied'
            THEN {ts_plus_minutes(__import__('datetime').datetime(2024, 2, 1), 'p_partkey')} + INTERVAL 1 DAY END AS applied_at
FROM part""")

cte("data_sources", (), f"""
SELECT 'ds-' || CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS name,
       {pick(vocab.SOURCE_TYPES, 's_suppkey')} AS source_type, {pick(vocab.SOURCE_STATUSES, 's_nationkey')} AS status,
       {ts_plus_minutes(V.EPOCH, 's_suppkey')} AS last_sync, s_suppkey * 1000 AS records_processed,
       90.0 + (s_suppkey % 100) / 10.0 AS data_quality, CAST(NULL AS TIMESTAMP) AS updated_at
FROM supplier""")

cte("scenarios", (), f"""
SELECT 'sc-' || CAST(s_suppkey AS VARCHAR) AS scenario_id, 'Scenario ' || CAST(s_suppkey AS VARCHAR) AS name,
       {pick(vocab.SCENARIO_TYPES, 's_suppkey')} AS scenario_type, {pick(V.SCENARIO_STATUSES, 's_suppkey')} AS status,
       CAST(NULL AS VARCHAR) AS last_run_id, CAST(NULL AS TIMESTAMP) AS last_run_at,
       {ts_plus_minutes(V.EPOCH, 's_suppkey')} AS updated_at
FROM supplier""")


def _perm(idx: str) -> str:
    return pick(vocab.KNOWN_PERMISSIONS, idx)


cte("access_controls", (), f"""
SELECT 'u-' || CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, c_mktsegment AS role,
       'dept-' || CAST(c_nationkey % 5 AS VARCHAR) AS department,
       CASE WHEN c_custkey % 10 = 0 THEN [{_perm('c_custkey')}, {_perm('c_custkey * 7 + 3')}, {q(V.UNKNOWN_PERMISSION)}, {_perm('c_custkey')}]
            WHEN c_custkey % 3 = 0 THEN [{_perm('c_custkey')}, {_perm('c_custkey * 7 + 3')}, {_perm('c_custkey * 5 + 1')}]
            ELSE [{_perm('c_custkey')}, {_perm('c_custkey * 7 + 3')}] END AS permissions,
       CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status,
       {ts_plus_minutes(V.EPOCH, 'c_custkey')} AS last_access, CAST(NULL AS TIMESTAMP) AS updated_at
FROM customer""")

cte("reports", (), f"""
SELECT 'rpt-' || CAST(o_orderkey AS VARCHAR) AS report_id, 'Order report ' || CAST(o_orderkey AS VARCHAR) AS title,
       {pick(vocab.REPORT_TYPES, 'o_orderkey')} AS report_type, 'generating' AS status,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS created_at,
       CAST(NULL AS TIMESTAMP) AS generated_at, CAST(NULL AS VARCHAR) AS object_key
FROM orders""")

cte("insights", (), f"""
SELECT 'in-' || CAST(o_orderkey AS VARCHAR) AS insight_id, {pick(V.INSIGHT_CATEGORIES, 'o_custkey')} AS category,
       'Insight ' || CAST(o_orderkey AS VARCHAR) AS title, {pick(vocab.SEVERITIES, 'o_orderkey')} AS impact,
       o_orderdate + to_seconds(CAST(o_orderkey AS BIGINT)) AS created_at
FROM orders""")

cte("governance_metrics", (), """
SELECT 'gov-' || event_type AS metric_id, ts, event_type || ' check' AS name, value, 100.0 AS threshold,
       CASE WHEN value > 150 THEN 'violation' WHEN value > 100 THEN 'warning' ELSE 'compliant' END AS status
FROM events""")

cte("bias_detections", (), f"""
SELECT 'bd-' || CAST(event_id AS VARCHAR) AS detection_id, {pick(V.MODEL_COMPONENTS, 'user_id')} AS model_component,
       {pick(V.BIAS_TYPES, 'event_id')} AS bias_type, {pick(vocab.SEVERITIES, 'event_id + user_id')} AS severity,
       {pick(V.BIAS_STATUSES, 'user_id + 1')} AS status, ts AS detected_at
FROM events""")

cte("alert_ack_requests", ("alarm_keyed",), """
SELECT CASE WHEN event_id % 50 = 7 THEN 'al-missing-' || CAST(event_id AS VARCHAR) ELSE 'al-' || id END AS alert_id,
       ts + INTERVAL 1 HOUR AS requested_at
FROM alarm_keyed WHERE event_id % 3 = 1 OR event_id % 50 = 7""")

cte("inventory_ack_requests", (), f"""
SELECT CASE WHEN p_partkey % 37 = 0 THEN 'ia-missing-' || CAST(p_partkey AS VARCHAR)
            ELSE 'ia-' || CAST(p_partkey AS VARCHAR) END AS alert_id,
       {ts_plus_minutes(__import__('datetime').datetime(2024, 6, 1), 'p_partkey')} AS requested_at
FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 37 = 0""")

cte("forecast_status_requests", (), f"""
SELECT {forecast_id_sql('CAST(p_partkey AS VARCHAR)')} AS forecast_id, {pick(('superseded', 'archived', 'bogus'), 'p_partkey % 4')} AS status,
       {ts_plus_minutes(__import__('datetime').datetime(2001, 7, 1), 'p_partkey')} AS requested_at
FROM part WHERE p_partkey % 4 <> 3""")

def _requests_sql(table: str, k: str, most: int, prefix: str, key: str, hot: str, where: str = "TRUE") -> str:
    return f"""(
  SELECT *, CASE WHEN k % 13 = 5 AND i = 0 THEN NULL WHEN k % 17 = 0 THEN '{prefix}missing-' || CAST(k AS VARCHAR)
                 WHEN k % 4 = 3 AND i = 1 THEN '{hot}' ELSE '{prefix}' || CAST(k AS VARCHAR) END AS {key},
         'rq-' || CAST(k AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS request_id
  FROM (SELECT *, {k} AS k, CAST(unnest(generate_series(0, {k} % {most})) AS BIGINT) AS i FROM {table} WHERE {where}) r)"""


def _half(base) -> str:
    return ts_plus_minutes(base, "floor((k + i) / 2)")


# patch fields as columns: NULL where the patch does not carry the field
cte("source_patches", (), f"""
SELECT source_id, request_id, {_half(__import__('datetime').datetime(2024, 3, 1))} AS requested_at,
       CASE (k + i) % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'paused' WHEN 4 THEN 'idle' END AS p_status,
       CASE (k + i) % 6 WHEN 0 THEN CAST(k * 1000 + 500 + i AS VARCHAR) WHEN 5 THEN 'lots' END AS p_records_processed,
       CASE (k + i) % 6 WHEN 3 THEN 'renamed ' || request_id END AS p_name,
       CASE (k + i) % 6 WHEN 4 THEN '97.5' END AS p_data_quality
FROM {_requests_sql('supplier', 's_suppkey', 5, 'ds-', 'source_id', 'ds-1')} x""")

cte("checked_patches", ("source_patches",), f"""
SELECT *, array_to_string(list_filter([CASE WHEN p_data_quality IS NOT NULL THEN 'data_quality' END,
           CASE WHEN p_name IS NOT NULL THEN 'name' END,
           CASE WHEN p_records_processed IS NOT NULL THEN 'records_processed' END,
           CASE WHEN p_status IS NOT NULL THEN 'status' END], lambda x: x IS NOT NULL), ',') AS kept_fields,
       CASE WHEN p_status IS NULL AND p_records_processed IS NULL AND p_name IS NULL AND p_data_quality IS NULL
            THEN {q('No updatable fields provided; allowed: ' + ', '.join(vocab.MUTABLE_SOURCE_FIELDS))}
            WHEN p_status IS NOT NULL AND p_status NOT IN ({', '.join(q(x) for x in vocab.SOURCE_STATUSES)})
            THEN {q('status must be one of: ' + ', '.join(vocab.SOURCE_STATUSES))}
            WHEN p_records_processed IS NOT NULL AND TRY_CAST(p_records_processed AS BIGINT) IS NULL
            THEN 'value does not fit the field''s type: records_processed' END AS error
FROM source_patches""")

cte("access_requests", (), f"""
SELECT user_id, request_id,
       CASE WHEN (k + i) % 20 = 0 THEN [{_perm('k * 3 + i')}, 'root_access', {_perm('k + 5')}]
            ELSE [{_perm('k + 5')}, {_perm('k * 3 + i')}] END AS permissions,
       'admin-' || CAST(k % 4 AS VARCHAR) || '@example.com' AS actor,
       {_half(__import__('datetime').datetime(2024, 4, 1))} AS requested_at
FROM {_requests_sql('customer', 'c_custkey', 5, 'u-', 'user_id', 'u-1', 'c_custkey % 2 = 0')} x""")

cte("report_requests", (), f"""
SELECT report_id, request_id, o_orderdate + to_hours(CAST(24 + floor(i / 2) AS BIGINT)) AS requested_at
FROM {_requests_sql('orders', 'o_orderkey', 4, 'rpt-', 'report_id', 'rpt-1', 'o_orderkey % 3 = 0')} x""")

cte("scenario_run_requests", (), f"""
SELECT 'sc-' || CAST(o_orderkey % 150 AS VARCHAR) AS scenario_id, {stable_id_sql('run-', 'o_orderkey')} AS run_id,
       o_orderdate + to_seconds(CAST(o_orderkey AS BIGINT)) AS requested_at
FROM orders""")

cte("apply_requests", (), f"""
SELECT optimization_id, request_id, {_half(__import__('datetime').datetime(2024, 5, 1))} AS requested_at
FROM {_requests_sql('part', 'p_partkey', 5, 'opt-', 'optimization_id', 'opt-3', 'p_partkey % 2 = 1')} x""")

cte("alert_create_requests", (), f"""
SELECT 'req-' || CAST(event_id AS VARCHAR) AS request_id,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN '' ELSE 'Event ' || CAST(event_id AS VARCHAR) END AS title,
       {pick(('info', 'warning', 'critical', None, 'panic'), 'event_id')} AS alert_type,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS category,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'message ' || CAST(event_id AS VARCHAR) END AS message,
       CASE WHEN event_id % 7 = 0 THEN 'ERP' END AS source,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 = 1 END AS action_required,
       CASE WHEN event_id % 6 = 0 THEN event_type END AS meta_origin, ts AS requested_at
FROM events""")


def with_views(names: list[str] | tuple[str, ...], select: str) -> str:
    """``WITH`` clause holding the named views and their dependencies, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return select.strip()
    body = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in order)
    return f"WITH {body}\n{select.strip()}"


# --- metric windows and alarm rules -------------------------------------------

def _rules_values() -> str:
    rows = ", ".join(f"({q(a)}, {q(n)}, {q(d)}, {q(s)}, {q(c)}, {t!r}, {p})" for a, n, d, s, c, t, p in vocab.ALARM_RULES)
    return f"SELECT * FROM (VALUES {rows}) v(alarm, name, dim_value, statistic, comparison, threshold, periods)"


cte("alarm_rules", (), _rules_values())

_P = vocab.ALARM_PERIOD_SECONDS

cte("window_stats", ("metrics",), f"""
SELECT metric_id, name, dim_value, ps AS period_start, ps + to_seconds({_P}) AS period_end,
       sum(value) AS sum, max(value) AS max, avg(value) AS avg, count(*) AS samples,
       quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99
FROM (SELECT *, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(floor(epoch(ts) / {_P}) * {_P} AS BIGINT)) AS ps
      FROM metrics) m
GROUP BY metric_id, name, dim_value, ps""")

cte("evaluated", ("window_stats", "alarm_rules"), """
SELECT alarm, name, dim_value, statistic, threshold, periods, period_start, period_end, stat_value,
       COALESCE(CASE comparison WHEN '>=' THEN stat_value >= threshold WHEN '>' THEN stat_value > threshold
                                WHEN '<' THEN stat_value < threshold WHEN '<=' THEN stat_value <= threshold END,
                FALSE) AS breach
FROM (SELECT s.*, r.alarm, r.statistic, r.comparison, r.threshold, r.periods,
             CASE r.statistic WHEN 'sum' THEN s.sum WHEN 'max' THEN s.max WHEN 'avg' THEN s.avg
                              WHEN 'p50' THEN s.p50 WHEN 'p99' THEN s.p99 END AS stat_value
      FROM window_stats s JOIN alarm_rules r ON s.name = r.name AND s.dim_value = r.dim_value) j""")


def _consecutive_sql() -> str:
    ns = sorted({r[6] for r in vocab.ALARM_RULES})
    whens = " ".join(
        f"WHEN periods = {n} THEN (sum(CAST(breach AS INTEGER)) OVER (PARTITION BY alarm ORDER BY ep "
        f"RANGE BETWEEN {(n - 1) * _P} PRECEDING AND CURRENT ROW)) = {n}" for n in ns)
    return (f"SELECT * EXCLUDE (ep), COALESCE(CASE {whens} END, FALSE) AS in_alarm "
            f"FROM (SELECT *, epoch(period_start) AS ep FROM evaluated) e")


cte("consecutive", ("evaluated",), _consecutive_sql())


# --- exact rounding of doubles (twin of functions.scalars.round_exact) ---------

def round_exact_sql(x: str, scale: int, ties: str = "even") -> str:
    """Round the exact binary value of ``x``: ties of x*10**s resolved by the
    sign of the product's rounding error (Dekker split); exact ties by
    ``ties``.  DuckDB's own round() loses that error on near-ties."""
    m = f"CAST({10 ** scale} AS DOUBLE)"
    X = f"CAST({x} AS DOUBLE)"
    p = f"({X} * {m})"
    c = f"({X} * CAST(134217729 AS DOUBLE))"
    xh = f"({c} - ({c} - {X}))"
    xl = f"({X} - {xh})"
    e = f"(({xh} * {m} - {p}) + {xl} * {m})"
    n = f"floor({p})"
    tie = f"({p} - {n} = 0.5)"
    exact = f"(CASE WHEN {n} % 2 = 0 THEN {n} ELSE {n} + 1 END)" if ties == "even" else f"({n} + 1)"
    r = (f"CASE WHEN {tie} AND {e} > 0 THEN {n} + 1 WHEN {tie} AND {e} < 0 THEN {n} "
         f"WHEN {tie} THEN {exact} ELSE round_even({p}, 0) END")
    return f"(({r}) / {m})"


# --- baseline forecast --------------------------------------------------------

def baseline_sql(source: str, horizon: str | int, demand_expr: str = "CAST(demand AS DOUBLE)",
                 where: str = "TRUE", extra_cols: str = "", context: int = vocab.CONTEXT_LENGTH) -> str:
    """Quantiles (0.1, 0.5, 0.9) of the last ``context`` points per product,
    flat over ``horizon`` steps (an int or a column of ``source``)."""
    qs = ", ".join(repr(x) for x in vocab.QUANTILES)
    hcol = f"{horizon}" if isinstance(horizon, int) else f"max({horizon})"
    return f"""
SELECT product_id, step, {next_period_sql('last_period', 'step')} AS period,
       {round_exact_sql('q[2]', 2)} AS demand, {round_exact_sql('q[1]', 2)} AS lower,
       {round_exact_sql('q[3]', 2)} AS upper, last_period{extra_cols}
FROM (SELECT product_id, q, last_period, CAST(unnest(generate_series(1, h)) AS INTEGER) AS step
      FROM (SELECT product_id, quantile_cont({demand_expr}, [{qs}]) AS q, max(period) AS last_period, {hcol} AS h
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY period DESC) AS rn
                  FROM {source} WHERE {where}) hh
            WHERE rn <= {context} GROUP BY product_id) a) b"""


CTES["fc_preds"] = (("demand_history",), baseline_sql("demand_history", V.FORECAST_HORIZON))
# the backtest of the two accuracy queries forecasts from the months before the cutoff
CTES["backtest_preds"] = (("demand_history",), baseline_sql("demand_history", V.FORECAST_HORIZON,
                                                            where=f"period < {q(V.BACKTEST_CUTOFF)}"))

cte("inference_requests", ("demand_history",), """
SELECT p.product_id, CAST(CAST(p.product_id AS BIGINT) % 30 AS INTEGER) AS horizon, d.period,
       CASE WHEN CAST(p.product_id AS BIGINT) % 19 = 0 AND d.period = p.last_period THEN NULL ELSE CAST(d.demand AS DOUBLE) END
         AS demand
FROM (SELECT product_id, max(period) AS last_period FROM demand_history GROUP BY 1) p
LEFT JOIN demand_history d ON p.product_id = d.product_id AND CAST(p.product_id AS BIGINT) % 17 <> 0""")

cte("inference_valid", ("inference_requests",), """
SELECT product_id, period, demand, horizon FROM inference_requests
WHERE horizon BETWEEN 1 AND 24 AND period IS NOT NULL
  AND product_id NOT IN (SELECT product_id FROM inference_requests WHERE period IS NOT NULL AND demand IS NULL)""")


def nth_request_sql(table: str, key: str, direction: str = "", where: str = "TRUE") -> str:
    """Requests with their number per key, ordered as the services would apply them."""
    return (f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY requested_at {direction}, request_id {direction}) AS rn "
            f"FROM {table} WHERE {key} IS NOT NULL AND {where})")


_KNOWN_SQL = "[" + ", ".join(q(p) for p in vocab.KNOWN_PERMISSIONS) + "]"

cte("metric_events", ("alerts", "forecasts", "forecast_runs", "inference_valid", "scenario_run_requests", "scenarios",
                      "apply_requests", "optimizations", "reports", "report_requests", "access_requests",
                      "access_controls"), f"""
SELECT 'Alerts' AS namespace, 'AlertsCreated' AS metric_name, CAST(1 AS DOUBLE) AS value, 'Count' AS unit,
       'AlertType=' || alert_type || ';Category=' || category AS dimensions, alert_id AS source_key FROM alerts
UNION ALL SELECT 'API', 'ForecastsRetrieved', CAST(least(count(*), {vocab.DEFAULT_PAGE_SIZE}) AS DOUBLE), 'Count', '', product_id
FROM forecast_runs GROUP BY product_id
UNION ALL SELECT 'ML', 'ForecastGenerated', 1, 'Count', '', forecast_id FROM forecasts
UNION ALL SELECT 'ML', 'ForecastAccuracy', accuracy, 'Percent', '', forecast_id FROM forecasts WHERE accuracy IS NOT NULL
UNION ALL SELECT DISTINCT 'ML', 'DirectInference', CAST(1 AS DOUBLE), 'Count', '', product_id FROM inference_valid
UNION ALL SELECT 'Operations', 'OptimizationRunStarted', 1, 'Count', 'Status=queued', r.run_id
FROM scenario_run_requests r JOIN scenarios s ON r.scenario_id = s.scenario_id
UNION ALL SELECT 'Operations', 'OptimizationApplied', 1, 'Count', '', r.optimization_id
FROM {nth_request_sql('apply_requests', 'optimization_id')} r JOIN optimizations o ON r.optimization_id = o.optimization_id
WHERE rn = 1 AND o.status = 'proposed'
UNION ALL SELECT 'Operations', 'ReportGenerated', 1, 'Count', 'ReportType=' || COALESCE(p.report_type, 'operational'),
       'reports/' || p.report_id || '/' || {iso_sql('r.requested_at')} || '.json'
FROM reports p JOIN report_requests r ON p.report_id = r.report_id
UNION ALL SELECT 'Governance', 'AccessControlChanged', 1, 'Count', '', r.user_id
FROM access_requests r JOIN access_controls a ON r.user_id = a.user_id
WHERE len(list_filter(r.permissions, lambda x: NOT list_contains({_KNOWN_SQL}, x))) = 0""")
