from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tephra.operators import windows as W


def series(spark, values, flag=False):
    rows = [("a", date(2000, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"sim string, time date, value {'boolean' if flag else 'double'}")


def column(df, c):
    return [r[0] for r in df.orderBy("time").select(c).collect()]


EVENTS = [1.0, 5.0, 5.0, 5.0, 1.0, 5.0, 5.0, 1.0, 5.0]


def test_event_starts(spark):
    df = series(spark, EVENTS).withColumn("hit", W.starts_of(F.col("value") > 4, 2, ["sim"]).cast("int"))
    assert column(df, "hit") == [0, 1, 1, 0, 0, 1, 0, 0, 0]


def test_run_hits(spark):
    df = W.run_hits(series(spark, EVENTS), F.col("value") > 4, F.col("value") < 0, 2, ["sim"])
    assert column(df, "hit") == [0, 1, 1, 1, 0, 1, 1, 0, 0]


def test_rolling_sum_needs_all_values(spark):
    df = series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]).withColumn("s", W.rolling("sum", F.col("value"), 3, ["sim"]))
    assert column(df, "s") == [None, None, None, None, None, 15.0]


def test_rolling_any(spark):
    df = series(spark, [False, True, False, False, False], True).withColumn("s", W.rolling_any(F.col("value"), 3, ["sim"]).cast("int"))
    assert column(df, "s") == [0, 1, 1, 1, 0]


def test_centred_even_window(spark):
    df = series(spark, [float(i) for i in range(20)]).withColumn("s", W.rolling("mean", F.col("value"), 10, ["sim"], center=True))
    got = column(df, "s")
    assert got[5] == 4.5 and got[15] == 14.5 and got[4] is None and got[16] is None


def test_rolling_median_of_short_series(spark):
    df = series(spark, [3.0, 1.0]).withColumn("s", W.rolling("median", F.col("value"), 3, ["sim"]))
    assert column(df, "s") == [None, None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.sampled_from([0.0, 1.0, None]), min_size=1, max_size=30), n=st.integers(1, 4))
def test_starts_lie_within_runs(spark, values, n):
    df = series(spark, values).withColumn("start", W.starts_of(F.col("value") > 0, n, ["sim"]))
    df = W.run_hits(df, F.col("value") > 0, F.lit(False), n, ["sim"])
    rows = df.orderBy("time").collect()
    state = [v == 1.0 for v in values]
    for i, row in enumerate(rows):
        assert row["start"] == (all(state[i : i + n]) and i + n <= len(values))
        a = b = i
        while a > 0 and state[a - 1] == state[i]:
            a -= 1
        while b + 1 < len(values) and state[b + 1] == state[i]:
            b += 1
        assert row["hit"] == (1 if state[i] and b - a + 1 >= n else 0)


def test_sliding_climatology_is_mean_of_window(spark):
    rows = [("a", date(2000 + y, m, 1), float(y * 12 + m)) for y in range(5) for m in (1, 7)]
    got = W.sliding_climatology(spark.createDataFrame(rows, "sim string, time date, value double"), ["sim"], 2000, 2002, years=3)
    found = {(r["start_year"], r["month"]): r["value"] for r in got.collect()}
    assert found[2000, 1] == pytest.approx((1 + 13 + 25) / 3) and found[2002, 7] == pytest.approx((31 + 43 + 55) / 3)


def test_day_window_wraps_the_year(spark):
    df = spark.createDataFrame([("a", 365, 1.0), ("a", 1, 3.0), ("a", 100, 9.0)], "sim string, doy int, value double")
    got = {r["doy"]: r["q"] for r in W.day_window_quantiles(df, ["sim"], [0.5], half=1).collect()}
    assert got[1] == [2.0] and got[364] == [1.0] and got[2] == [3.0] and got[99] == [9.0]
