"""Column-level functions (all JVM-side built-ins, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

from tidemark import vocab

PRICE_TYPE = DecimalType(12, 2)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# --- ETL ----------------------------------------------------------------------

def price_to_decimal(col: str | Column) -> Column:
    """String price -> decimal(12,2); unparsable or overflowing text -> null.

    ``try_cast`` keeps the failure as a null signal under ANSI mode, where a
    plain cast would fail the whole job.
    """
    return _c(col).try_cast(PRICE_TYPE)


def line_total(quantity: str | Column, unit_price: str | Column) -> Column:
    """int x decimal(12,2) -> decimal(23,2), exact."""
    return _c(quantity) * _c(unit_price)


def default_channel(col: str | Column) -> Column:
    return F.coalesce(_c(col), F.lit(vocab.DEFAULT_CHANNEL))


def year_of(col: str | Column) -> Column:
    return F.year(_c(col))


def month_of(col: str | Column) -> Column:
    return F.month(_c(col))


def period_of(col: str | Column) -> Column:
    """Month period text ``yyyy-MM``."""
    return F.date_format(_c(col), "yyyy-MM")


# --- alerts -------------------------------------------------------------------

def classify_category(name: str | Column) -> Column:
    """First category whose keyword occurs in the lower-cased name, else system."""
    lowered = F.lower(_c(name))
    expr = None
    for category, keywords in vocab.CATEGORY_KEYWORDS:
        cond = None
        for kw in keywords:
            hit = lowered.contains(kw)
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit(vocab.DEFAULT_CATEGORY))


def classify_severity(name: str | Column) -> Column:
    return F.when(F.lower(_c(name)).contains("critical"), F.lit("critical")).otherwise(F.lit("warning"))


def severity_rank(col: str | Column) -> Column:
    """Operational order critical < high < medium < low (unknown last)."""
    expr = None
    for sev, rank in vocab.SEVERITY_RANK:
        expr = F.when(_c(col) == sev, F.lit(rank)) if expr is None else expr.when(_c(col) == sev, F.lit(rank))
    return expr.otherwise(F.lit(len(vocab.SEVERITY_RANK)))


def notify_subject(title: str | Column, prefix: str = "Critical Alert: ") -> Column:
    """Notification subject, cut to the first 100 characters."""
    return F.substring(F.concat(F.lit(prefix), _c(title)), 1, vocab.NOTIFY_SUBJECT_MAX)


def json_object_text(*pairs: tuple[str, Column]) -> Column:
    """JSON object text with Python ``json.dumps`` separators (``", "`` and
    ``": "``); each value is JSON-escaped by ``to_json``.  (Non-ASCII text is
    written as UTF-8, where ``json.dumps`` would use \\u escapes.)"""
    parts = []
    for i, (key, value) in enumerate(pairs):
        text = F.to_json(F.array(value))  # the value between brackets, cut off by position
        encoded = F.substr(text, F.lit(2), F.length(text) - 2)
        parts += [F.lit(("{" if i == 0 else ", ") + '"' + key + '": '), F.coalesce(encoded, F.lit("null"))]
    parts.append(F.lit("}"))
    return F.concat(*parts)


def iso_utc(col: str | Column) -> Column:
    """Render a timestamp as ISO-8601 text (seconds precision) at the edge."""
    return F.date_format(_c(col), "yyyy-MM-dd'T'HH:mm:ss")


def stable_id(prefix: str, *keys: str | Column) -> Column:
    """Deterministic id: prefix + uuid-shaped md5 of the source key.

    Re-running a job, or retrying a task after an executor loss, yields the
    same id, unlike a random uuid.
    """
    h = F.md5(F.concat_ws("|", *[_c(k).cast("string") for k in keys]))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
             F.substring(h, 17, 4), F.substring(h, 21, 12)]
    return F.concat(F.lit(prefix), F.concat_ws("-", *parts))


# --- rounding -----------------------------------------------------------------

_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp split of a double into two 26-bit halves


def round_exact(col: str | Column, scale: int, ties: str = "even") -> Column:
    """Round a double to ``scale`` places by its exact binary value.

    Python's ``round(x, n)`` (ties to even) and SQL engines that round doubles
    decide on the exact binary value: 32.175 is stored as 32.17499999... and
    rounds down.  Spark's ``bround``/``round`` on doubles decide on the printed
    value ("32.175") instead.  Here p = x * 10**s is computed together with its
    exact rounding error e (Dekker: x is split into two 26-bit halves, each
    product with a small integer is exact), so a tie of p is resolved by the
    sign of e; only an exact binary tie uses the ``ties`` rule ("even" or
    "up" = away from zero for positive values).  The result is r / 10**s,
    the double nearest the decimal, like Python.  Built-ins only, so it stays
    inside whole-stage codegen.
    """
    if not 0 <= scale <= 7:
        raise ValueError("scale must be in 0..7 (10**scale must fit 26 bits)")
    x = _c(col).cast("double")
    m = float(10 ** scale)
    p = x * F.lit(m)
    c = x * F.lit(_SPLIT)
    xh = c - (c - x)
    xl = x - xh
    e = (xh * F.lit(m) - p) + xl * F.lit(m)
    n = F.floor(p).cast("double")
    tie = (p - n) == F.lit(0.5)
    if ties == "even":
        exact_tie = F.when(F.pmod(n, F.lit(2.0)) == 0, n).otherwise(n + 1)
    elif ties == "up":
        exact_tie = n + 1
    else:
        raise ValueError("ties must be 'even' or 'up'")
    r = (F.when(tie & (e > 0), n + 1)
          .when(tie & (e < 0), n)
          .when(tie, exact_tie)
          .otherwise(F.rint(p)))
    return F.when(x.isNull() | F.isnan(x), x).otherwise(r / F.lit(m))


def round_half_even(col: str | Column, scale: int) -> Column:
    """Python ``round(x, n)`` on floats."""
    return round_exact(col, scale, "even")


def js_round(col: str | Column, scale: int = 1) -> Column:
    """JavaScript ``Math.round(x * 10**s) / 10**s`` (ties toward +inf)."""
    f = 10 ** scale
    return F.floor(_c(col) * f + F.lit(0.5)) / F.lit(float(f))


def quality_band(col: str | Column) -> Column:
    c = _c(col)
    return F.when(c > 95, "green").when(c > 90, "yellow").otherwise("red")


# --- governance ---------------------------------------------------------------

def known_permissions() -> Column:
    return lit_array(vocab.KNOWN_PERMISSIONS)


def permissions_unknown(col: str | Column) -> Column:
    """sorted(set(perms) - known): array_except also removes duplicates."""
    return F.array_sort(F.array_except(_c(col), known_permissions()))


def permissions_sorted(col: str | Column) -> Column:
    return F.array_sort(_c(col))


# --- forecast periods ---------------------------------------------------------

_INT_TEXT = r"^\s*\+?[0-9]+\s*$"


def _period_parts(last_period: Column):
    parts = F.split(F.coalesce(last_period, F.lit("")), "-")
    y_txt, m_txt = F.get(parts, 0), F.get(parts, 1)
    ok = (F.size(parts) >= 2) & y_txt.rlike(_INT_TEXT) & m_txt.rlike(_INT_TEXT)
    y = F.trim(y_txt).try_cast("int")
    m = F.trim(m_txt).try_cast("int")
    return ok & y.isNotNull() & m.isNotNull(), y, m


def next_periods(last_period: str | Column, horizon: str | Column | int) -> Column:
    """The ``horizon`` month periods after ``last_period`` (``YYYY-MM[-...]``).

    Counting starts from month min(m, 12): stepping past December rolls the
    year, and a month above 12 first rolls to January of the next year.
    Text that does not split into two integers yields ``t+1 .. t+h``.
    """
    ok, y, m = _period_parts(_c(last_period))
    h = F.lit(horizon) if isinstance(horizon, int) else _c(horizon)
    base = y * 12 + F.least(m, F.lit(12)) - 1

    def step(i: Column) -> Column:
        total = base + i
        yy = F.floor(total / 12).cast("int")
        mm = (total - yy * 12 + 1).cast("int")
        dated = F.format_string("%04d-%02d", yy, mm)  # lpad would cut a 5-digit year
        return F.when(ok, dated).otherwise(F.concat(F.lit("t+"), i.cast("string")))

    return F.transform(F.sequence(F.lit(1), h.cast("int")), step)


def context_tail(arr: str | Column, n: int = vocab.CONTEXT_LENGTH) -> Column:
    """Last ``n`` elements; the whole array when it is shorter."""
    a = _c(arr)
    return F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n)
