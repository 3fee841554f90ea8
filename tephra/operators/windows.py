"""Window operators over ordered series: rolling reductions, runs, lags, anomalies, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDUCE = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5)), "count": F.count}


def series(keys: list[str], time: str = "time"):
    return Window.partitionBy(*keys).orderBy(time)


def rolling(how: str, value: Column, n: int, keys: list[str], time: str = "time", min_periods: int | None = None, center: bool = False) -> Column:
    """Reduction over n steps, NULL where fewer than min_periods (default n) values are there; a centred even window leans back."""
    frame = (-(n // 2), n - n // 2 - 1) if center else (1 - n, 0)
    w = series(keys, time).rowsBetween(*frame)
    return F.when(F.count(value).over(w) >= (n if min_periods is None else min_periods), REDUCE[how](value).over(w))


def rolling_any(flag: Column, n: int, keys: list[str], time: str = "time") -> Column:
    return F.max(F.coalesce(flag, F.lit(False)).cast("int")).over(series(keys, time).rowsBetween(1 - n, 0)) == 1


def consecutive(flag: Column, n: int, keys: list[str], time: str = "time") -> Column:
    """True where the last n steps all have the flag."""
    w = series(keys, time).rowsBetween(1 - n, 0)
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(w) >= n


def starts_of(flag: Column, n: int, keys: list[str], time: str = "time") -> Column:
    """True on a step from which n steps in a row have the flag; a series' end is too short for that."""
    w = series(keys, time).rowsBetween(0, n - 1)
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(w) >= n


def with_runs(df: DataFrame, flag: Column, keys: list[str], time: str = "time", run: str = "run_id", length: str = "run_length") -> DataFrame:
    """Adds the number of each stretch of equal flags within its series, from 1, and the stretch's length."""
    w = series(keys, time)
    value = F.coalesce(flag, F.lit(False)).cast("int")
    df = df.withColumn("__flag", value).withColumn("__new", (F.col("__flag") != F.coalesce(F.lag("__flag").over(w), F.lit(-1))).cast("int"))
    df = df.withColumn(run, F.sum("__new").over(w))
    return df.withColumn(length, F.count("*").over(Window.partitionBy(*keys, run)).cast("int")).drop("__flag", "__new")


def run_hits(df: DataFrame, high: Column, low: Column, n: int, keys: list[str], time: str = "time", hit: str = "hit") -> DataFrame:
    """Adds +1 on every step of a run of n or more high steps, -1 on those of low steps, else 0."""
    df = df.withColumn("__state", F.when(high, 1).when(low, -1).otherwise(0))
    w = series(keys, time)
    df = df.withColumn("__new", (F.col("__state") != F.coalesce(F.lag("__state").over(w), F.lit(9))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    size = F.count("*").over(Window.partitionBy(*keys, "__run"))
    return df.withColumn(hit, F.when(size >= n, F.col("__state")).otherwise(0)).drop("__state", "__new", "__run")


def step_hours(keys: list[str], time: str = "time") -> Column:
    """Hours since the step before."""
    return (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(series(keys, time)).cast("timestamp"))) / 3.6e9


def baseline_anomaly(value: Column, keys: list[str], time: str, first: int, last: int) -> Column:
    """value less its series' mean over the years first to last."""
    inside = F.when(F.year(time).between(first, last), value)
    return value - F.avg(inside).over(Window.partitionBy(*keys))


def deseasonalised(value: Column, keys: list[str], time: str = "time") -> Column:
    return value - F.avg(value).over(Window.partitionBy(*keys, F.month(time)))


def top_n(df: DataFrame, n: int, keys: list[str], *order, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def sliding_climatology(df: DataFrame, keys: list[str], first: int, last: int, years: int = 30, time: str = "time", value: str = "value") -> DataFrame:
    """Monthly means of each window of `years` years that starts in first..last: (keys, start_year, month, value)."""
    monthly = df.groupBy(*keys, F.year(time).alias("year"), F.month(time).alias("month")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    starts = F.explode(F.sequence(F.col("year") - (years - 1), F.col("year")))
    windows = monthly.withColumn("start_year", starts).where(F.col("start_year").between(first, last))
    return windows.groupBy(*keys, "start_year", "month").agg((F.sum("s") / F.sum("n")).alias(value))


def day_window_quantiles(df: DataFrame, keys: list[str], probabilities: list[float], half: int = 45, day: str = "doy", value: str = "value", year_days: int = 365) -> DataFrame:
    """Quantiles of all values within `half` days of each day of the year, around its end too: (keys, day, q). Days without any value near have no row.

    A range frame over the series slides along the days, so a value is not dealt to every day near it; only those near the year's ends are repeated."""
    held = df.where(F.col(value).isNotNull()).select(*keys, F.col(day).cast("int").alias(day), F.col(value).cast("double").alias(value))
    near = lambda d: (d >= 1 - half) & (d <= year_days + half)
    around = held.withColumn(day, F.explode(F.filter(F.array(F.col(day), F.col(day) - year_days, F.col(day) + year_days), near)))
    asked = held.select(*keys, F.lit(1).alias("__one")).distinct().drop("__one").withColumn(day, F.explode(F.sequence(F.lit(1), F.lit(year_days)))).withColumn(value, F.lit(None).cast("double"))
    rows = around.withColumn("__ask", F.lit(False)).unionByName(asked.withColumn("__ask", F.lit(True)))
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-half, half)
    return rows.withColumn("q", F.percentile(value, F.array(*map(F.lit, probabilities))).over(w)).where(F.col("__ask") & F.col("q").isNotNull()).select(*keys, day, "q")
