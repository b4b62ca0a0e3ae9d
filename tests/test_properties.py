"""Property tests: column functions against their plain-Python definitions.

Each example is a whole list evaluated in one Spark job."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.functions import scalars as S

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

decimals_3dp = st.integers(min_value=0, max_value=10**7).map(lambda k: k / 1000)
finite = st.floats(min_value=0, max_value=1e6, allow_nan=False, allow_infinity=False)


def next_period_list(last, horizon):
    """The period rule in plain Python."""
    parts = last.split("-")
    try:
        y, m = int(parts[0]), int(parts[1])
    except (ValueError, IndexError):
        return [f"t+{i}" for i in range(1, horizon + 1)]
    base = y * 12 + min(m, 12) - 1
    return [f"{(base + i) // 12:04d}-{(base + i) % 12 + 1:02d}" for i in range(1, horizon + 1)]


@SETTINGS
@given(st.lists(st.one_of(decimals_3dp, finite), min_size=1, max_size=400), st.integers(min_value=0, max_value=4))
def test_round_exact_is_python_round(spark, xs, scale):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r[0] for r in df.select(S.round_exact("x", scale)).collect()]
    assert got == [round(float(x), scale) for x in xs]


periods = st.one_of(
    st.builds(lambda y, m: f"{y}-{m}", st.integers(0, 9999), st.integers(0, 40)),
    st.builds(lambda y, m: f"{y:04d}-{m:02d}-15", st.integers(1, 9999), st.integers(1, 12)),
    st.text(alphabet="0123456789-+ x", max_size=8),
)


@SETTINGS
@given(st.lists(periods, min_size=1, max_size=200), st.integers(min_value=1, max_value=24))
def test_next_periods_matches_python_rule(spark, ps, h):
    df = spark.createDataFrame([(p,) for p in ps], "p string")
    got = [r[0] for r in df.select(S.next_periods("p", h)).collect()]
    assert got == [next_period_list(p, h) for p in ps]
