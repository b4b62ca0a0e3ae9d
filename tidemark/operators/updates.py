"""Guarded updates as joins: a table of requests applied to a table of records.

A batch may hold several requests for one key.  The services apply them one after
the other; here their joint effect is folded per key with partial aggregates
(``max_by`` of the newest, per field where requests change single fields), so a key
that holds a third of all requests ships one row per map task.  The target join is
then one-to-one on the primary key; AQE picks broadcast at run time when the
request side is measured small, a sort-merge join otherwise.

Requests are ordered by (requested_at, request_id); without a ``request_id`` column
by requested_at and the request's remaining columns, so that the order never
depends on which task was retried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import vocab
from tidemark.functions import scalars as S
from tidemark.operators import validate as V


def request_order(requests: DataFrame, ts: str = "requested_at", key: str | None = None) -> Column:
    """When a request counts, as one value comparable within ``key``; a missing time
    comes first."""
    if "request_id" in requests.columns:
        tie = F.col("request_id").cast("string")
    else:
        rest = [f.name for f in requests.schema.fields if f.name not in (ts, key)]
        tie = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("")
    return F.struct(F.col(ts).alias("at"), tie.alias("tie"))


def latest_request(requests: DataFrame, key: str, ts: str = "requested_at") -> DataFrame:
    """The newest request of each key; requests without a key are left out."""
    rest = [c for c in requests.columns if c != key]
    newest = F.max_by(F.struct(*rest), request_order(requests, ts, key)).alias("_r")
    return requests.filter(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, "_r.*")


def update_existing(target: DataFrame, updates: DataFrame, key: str,
                    assignments: dict[str, Column]) -> DataFrame:
    """New snapshot of ``target``: matched rows get ``assignments`` (expressions
    over the request columns), others are unchanged.  Keys not in the target
    are not inserted (``update_not_found`` lists them)."""
    return _assigned(target, latest_request(updates, key), key, assignments)


def _assigned(target: DataFrame, one_per_key: DataFrame, key: str, assignments: dict[str, Column]) -> DataFrame:
    new_cols = [expr.alias(f"__new_{name}") for name, expr in assignments.items()]
    u = one_per_key.select(F.col(key), F.lit(True).alias("__hit"), *new_cols)
    j = target.join(u, key, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    out = []
    for c in target.columns:
        if c in assignments:
            out.append(F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    extra = [F.when(hit, F.col(f"__new_{n}")).alias(n) for n in assignments if n not in target.columns]
    return j.select(*out, *extra, hit.alias("updated"))


def existing_keys(target: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Target keys that some request names.

    The target is the streamed side of a semi join against the distinct
    request keys (broadcast by AQE when the request batch is small), so a
    small batch never shuffles a large target; the result is at most as
    large as the request key set and is itself cheap to join back.
    """
    return target.select(key).join(requests.select(key).distinct(), key, "left_semi")


def update_not_found(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The 404 set of a batch of updates."""
    return updates.join(existing_keys(target, updates, key), key, "left_anti")


_SALTS = 16


def _with_existing(requests: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``requests`` with ``_exists`` where ``keys`` (distinct) holds their key.  The
    requests of one key are dealt over _SALTS join partitions, so that a key with a
    third of them does not meet in one task; ``keys`` is repeated that often."""
    own = [F.col(c) for c in ("requested_at", "request_id") if c in requests.columns]
    salt = F.pmod(F.xxhash64(*own), F.lit(_SALTS)) if own else F.lit(0)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1 if own else 0).cast("long")))
    known = keys.select(key, F.lit(True).alias("_exists"), every.alias("_salt"))
    return requests.withColumn("_salt", salt.cast("long")).join(known, [key, "_salt"], "left").drop("_salt")


def request_outcomes(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Every request with 200 (key exists) or 404."""
    j = _with_existing(updates, existing_keys(target, updates, key), key)
    return j.withColumn("status_code", F.when(F.col("_exists"), F.lit(200)).otherwise(F.lit(404))).drop("_exists")


# --- the record jobs ---------------------------------------------------------

def acknowledge(target: DataFrame, requests: DataFrame, key: str = "alert_id") -> DataFrame:
    """Set acknowledged and acknowledged_at; a second ack only moves the time."""
    return update_existing(target, requests, key, {
        "acknowledged": F.lit(True),
        "acknowledged_at": F.col("requested_at"),
    })


def forecast_status_update(forecasts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new forecasts snapshot, per-request outcome 200/400/404)."""
    checked = V.validate_enum(requests, "status", vocab.FORECAST_STATUSES)
    valid = checked.filter(F.col("status_code") == 200).drop("status_code", "error")
    snapshot = update_existing(forecasts, valid, "forecast_id",
                               {"status": F.col("status"), "updated_at": F.col("requested_at")})
    outcomes = _outcomes(forecasts, checked.drop("status_code"), "forecast_id")
    return snapshot, outcomes


def _outcomes(target: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """One join: 400 when the request failed validation (``error`` set),
    else 200 / 404 by key existence."""
    j = _with_existing(checked, existing_keys(target, checked, key), key)
    code = (F.when(F.col("error").isNotNull(), F.lit(400))
             .when(F.col("_exists"), F.lit(200)).otherwise(F.lit(404)))
    return j.withColumn("status_code", code).drop("_exists")


def data_source_patch(sources: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new sources snapshot, per-request outcome).

    Rejected (400): no mutable field, an unknown status, a value that does not fit
    its field's type.  Accepted patches of one source add up: each field takes the
    value of the newest patch that carries it.
    """
    kept = V.whitelist_update_fields("patch")
    types = {c: t for c, t in sources.dtypes if c in vocab.MUTABLE_SOURCE_FIELDS}
    fields = [c for c in sources.columns if c in types]

    def given(field: str) -> Column:
        return F.coalesce(F.map_contains_key(F.col("kept"), F.lit(field)), F.lit(False))

    def value(field: str) -> Column:
        return F.element_at(F.col("kept"), F.lit(field))

    misfit = [F.when(given(c) & value(c).isNotNull() & value(c).try_cast(types[c]).isNull(), F.lit(c)) for c in fields]
    checked = patches.withColumn("kept", kept)
    err = (F.when(F.coalesce(F.size("kept"), F.lit(0)) <= 0,
                  F.lit("No updatable fields provided; allowed: " + ", ".join(vocab.MUTABLE_SOURCE_FIELDS)))
            # a status key that is present must hold a known status (null included)
            .when(given("status") & ~F.coalesce(value("status").isin(*vocab.SOURCE_STATUSES), F.lit(False)),
                  F.lit("status must be one of: " + ", ".join(vocab.SOURCE_STATUSES)))
            .when(F.size(F.array_compact(F.array(*misfit))) > 0,
                  F.concat(F.lit("value does not fit the field's type: "),
                           F.array_join(F.array_compact(F.array(*misfit)), ", "))))
    checked = checked.withColumn("error", err)
    valid = checked.filter(F.col("error").isNull() & F.col("source_id").isNotNull())
    # typed here: kept values fit; a carried null stays a null that is set
    order = request_order(patches)
    folded = valid.withColumn("_order", order).groupBy("source_id").agg(
        F.max("requested_at").alias("_at"),
        *[F.max_by(F.struct(value(c).try_cast(types[c]).alias("v")), F.when(given(c), F.col("_order"))).alias(f"_{c}")
          for c in fields],
        *[F.max(given(c)).alias(f"_has_{c}") for c in fields])
    j = sources.join(folded, "source_id", "left")
    cols = []
    for c in sources.columns:
        if c in fields:
            cols.append(F.when(F.coalesce(F.col(f"_has_{c}"), F.lit(False)), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.coalesce(F.col("_at"), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    ids = [c for c in ("request_id",) if c in patches.columns]
    outcomes = _outcomes(sources, checked.select("source_id", *ids, "requested_at", "error"), "source_id")
    return j.select(*cols), outcomes


def access_replace(acl: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new access snapshot, per-request outcome, audit rows).

    Unknown permission words reject the request (400) before any lookup;
    unknown users get 404; accepted changes write one audit row each.
    """
    unknown = S.permissions_unknown("permissions")
    not_strings = F.col("permissions").isNull() | F.exists("permissions", lambda p: p.isNull())
    checked = requests.withColumn("unknown", unknown).withColumn(
        "error", F.when(not_strings, F.lit("permissions must be an array of strings"))
                  .when(F.size(F.col("unknown")) > 0,
                        F.concat(F.lit("Unknown permission(s): "), F.array_join(F.col("unknown"), ", "))))
    valid = checked.filter(F.col("error").isNull()).drop("unknown", "error")
    ids = [c for c in ("request_id",) if c in requests.columns]
    snapshot = update_existing(acl, valid.select("user_id", *ids, "permissions", "requested_at"), "user_id",
                               {"permissions": F.col("permissions"), "updated_at": F.col("requested_at")})
    outcomes = _outcomes(acl, checked.select("user_id", *ids, "requested_at", "error"), "user_id")
    audit = audit_before_after(acl, valid)
    return snapshot, outcomes, audit


def _with_previous(requests: DataFrame, key: str, value: Column) -> DataFrame:
    """``requests`` with ``_previous``: a struct that holds ``value`` of the request before
    it for the same key, null for the key's first.

    Requests are put in order inside (key, hour); the last value of an hour is a
    partial aggregate, and one row per hour carries it on to the next.  So the
    requests of a hot key are dealt over its hours.
    """
    hour = F.coalesce(F.date_format("requested_at", "yyyyMMddHH"), F.lit(""))
    rows = requests.withColumns({"_order": request_order(requests), "_hour": hour, "_value": F.struct(value.alias("v"))})
    inside = Window.partitionBy(key, "_hour").orderBy("_order")
    last = rows.groupBy(key, "_hour").agg(F.max_by("_value", "_order").alias("_last"))
    carried = last.select(key, "_hour", F.lag("_last").over(Window.partitionBy(key).orderBy("_hour")).alias("_carried"))
    rows = rows.withColumn("_here", F.lag("_value").over(inside)).join(carried, [key, "_hour"])
    return rows.withColumn("_previous", F.coalesce("_here", "_carried")).drop("_order", "_hour", "_value", "_here", "_carried")


def audit_before_after(acl: DataFrame, accepted: DataFrame) -> DataFrame:
    """One audit row per change.  Before a user's first change stands the table's set,
    before each later one the set that the change before it left."""
    stored = acl.select("user_id", F.col("permissions").alias("_stored"))
    j = _with_previous(accepted, "user_id", F.col("permissions")).join(stored, "user_id")
    none = F.array().cast("array<string>")
    j = j.withColumn("_before", F.when(F.col("_previous").isNull(), F.coalesce("_stored", none))
                     .otherwise(F.col("_previous.v")))
    return j.select(
        F.lit("access_control_change").alias("audit"),
        F.coalesce(F.col("actor"), F.lit("anonymous")).alias("actor"),
        F.col("user_id").alias("subject"),
        S.permissions_sorted("_before").alias("before"),
        S.permissions_sorted(F.col("permissions")).alias("after"),
        F.col("requested_at").alias("at"),
    )


def _report_key(report: Column, at: Column) -> Column:
    return F.concat(F.lit("reports/"), report, F.lit("/"), S.iso_utc(at), F.lit(".json"))


def report_generate(reports: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new reports snapshot, artifacts).

    Every request for a known report makes an artifact, which embeds the record as
    it was read before that request: the stored one for the first, with the marks
    of the request before it for a later one.  The snapshot carries the newest:
    ready, generated_at and object_key ``reports/{id}/{generated_at}.json``.
    """
    snapshot = update_existing(reports, requests, "report_id", {
        "status": F.lit("ready"),
        "generated_at": F.col("requested_at"),
        "object_key": _report_key(F.col("report_id"), F.col("requested_at")),
    })
    asked = _with_previous(requests.filter(F.col("report_id").isNotNull()), "report_id", F.col("requested_at"))
    asked = asked.select("report_id", F.col("requested_at").alias("_at"), "_previous")
    j = asked.join(reports, "report_id")
    again = F.col("_previous").isNotNull()
    read = {"status": F.when(again, F.lit("ready")).otherwise(F.col("status")),
            "generated_at": F.when(again, F.col("_previous.v")).otherwise(F.col("generated_at")),
            "object_key": F.when(again, _report_key(F.col("report_id"), F.col("_previous.v"))).otherwise(F.col("object_key"))}
    definition = F.struct(*[read.get(c, F.col(c)).alias(c) for c in reports.columns])
    artifacts = j.select(
        "report_id", _report_key(F.col("report_id"), F.col("_at")).alias("object_key"),
        F.to_json(F.struct(
            F.col("report_id").alias("reportId"),
            F.coalesce(F.col("title"), F.lit("")).alias("title"),
            F.coalesce(F.col("report_type"), F.lit(vocab.DEFAULT_REPORT_TYPE)).alias("reportType"),
            S.iso_utc(F.col("_at")).alias("generatedAt"),
            definition.alias("definition"),
        )).alias("artifact"),
        F.date_format("_at", "yyyy-MM").alias("generated_month"),
    )
    return snapshot, artifacts


def scenario_run_record(scenarios: DataFrame, runs: DataFrame,
                        executor_available: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new scenarios snapshot, run records).

    The scenario id is checked before anything is dispatched (trap T10):
    runs for unknown scenarios are rejected and never reach an executor.
    """
    outcome = request_outcomes(scenarios, runs, "scenario_id")
    started = "running" if executor_available else "queued"
    run_records = outcome.select(
        "run_id", "scenario_id", "requested_at",
        F.when(F.col("status_code") == 200, F.lit(started)).otherwise(F.lit("rejected")).alias("run_status"),
        "status_code",
    )
    accepted = run_records.filter(F.col("status_code") == 200)
    snapshot = update_existing(scenarios, accepted, "scenario_id", {
        "status": F.lit(started),
        "last_run_id": F.col("run_id"),
        "last_run_at": F.col("requested_at"),
        "updated_at": F.col("requested_at"),
    })
    return snapshot, run_records


def apply_if_proposed(optimizations: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply only a 'proposed' recommendation: of the requests for a key exactly one,
    the first, wins; later ones, unknown and missing keys get 404.

    The first request of a key is a partial aggregate, and winners are joined back
    on the request's own id, which no key can make hot.  Requests without a
    ``request_id`` column that repeat key and time count as one request.
    """
    ordered = requests if "request_id" in requests.columns else requests.withColumn(
        "request_id", S.stable_id("", "optimization_id", "requested_at"))
    first = (ordered.filter(F.col("optimization_id").isNotNull()).groupBy("optimization_id")
             .agg(F.min(request_order(ordered)).alias("_first")))
    open_ = optimizations.filter(F.col("status") == "proposed").select("optimization_id")
    winners = first.join(open_, "optimization_id", "left_semi").select(
        "optimization_id", F.col("_first.at").alias("requested_at"), F.col("_first.tie").alias("request_id"))
    won = winners.select(F.col("request_id").alias("_won"), F.col("optimization_id").alias("_key"))
    j = ordered.join(won, (F.col("request_id").cast("string") == F.col("_won"))
                     & (F.col("optimization_id") == F.col("_key")), "left")
    applies = F.col("_won").isNotNull()
    ids = ["request_id"] if "request_id" in requests.columns else []
    outcomes = j.select("optimization_id", *ids, "requested_at",
                        F.when(applies, F.lit("applied")).otherwise(F.lit("not_found_or_applied")).alias("outcome"),
                        F.when(applies, F.lit(200)).otherwise(F.lit(404)).alias("status_code"))
    snapshot = _assigned(optimizations, winners, "optimization_id",
                         {"status": F.lit("applied"), "applied_at": F.col("requested_at")})
    return snapshot, outcomes
