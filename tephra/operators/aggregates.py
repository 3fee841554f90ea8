"""Aggregations: reductions over dimensions, calendars, quantiles, histograms, weights, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5)), "count": F.count,
    "var": F.var_pop, "std": F.stddev_pop, "var_sample": F.var_samp, "std_sample": F.stddev_samp,
}
PERIODS = {"day": "day", "month": "month", "year": "year", "hour": "hour"}


def reduce(df: DataFrame, keys: list[str], metrics: list[str], value: str = "value") -> DataFrame:
    """One column for each metric, missing values skipped; the dimensions that aren't keys are reduced."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}; there are {sorted(METRICS)}")
    return df.groupBy(*keys).agg(*[METRICS[m](value).alias(m) for m in metrics])


def resample(df: DataFrame, keys: list[str], period: str, how: str = "mean", time: str = "time", value: str = "value") -> DataFrame:
    """Means, sums and so on by calendar period, labelled by its first day (or hour)."""
    label = F.date_trunc(PERIODS[period], F.col(time))
    label = label if period == "hour" else label.cast("date")
    return df.groupBy(*keys, label.alias(time)).agg(METRICS[how](value).alias(value))


def quantiles(df: DataFrame, keys: list[str], probabilities: list[float], value: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation in one pass: columns q_<percent>."""
    q = F.percentile(value, F.array(*map(F.lit, probabilities)))
    got = df.groupBy(*keys).agg(q.alias("__q"))
    return got.select(*keys, *[F.col("__q")[i].alias(f"q_{round(p * 100)}") for i, p in enumerate(probabilities)])


def exceedance_rate(flag: Column, years) -> Column:
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")) / years


def fraction(flag: Column, valid: Column) -> Column:
    """Share of valid cells that have the flag."""
    return F.try_divide(F.count_if(valid & flag), F.count_if(valid))


def bins(value: Column, low: float, high: float, n: int) -> Column:
    """Bin 0..n-1 of equal width, the last one closed; NULL outside."""
    at = F.floor((value - low) / ((high - low) / n)).cast("int")
    return F.when((value >= low) & (value < high), F.least(at, F.lit(n - 1))).when(value == high, n - 1)


def histogram(df: DataFrame, keys: list[str], low: float, high: float, n: int, value: str = "value") -> DataFrame:
    return df.withColumn("bin", bins(F.col(value), low, high, n)).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("count"))


def empirical_cdf(df: DataFrame, keys: list[str], low: float, high: float, n: int, value: str = "value") -> DataFrame:
    """Histogram with each bin's share and the cumulated share."""
    h = histogram(df, keys, low, high, n, value)
    whole = Window.partitionBy(*keys)
    run = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumn("share", F.col("count") / F.sum("count").over(whole)).withColumn("cdf", F.sum("count").over(run) / F.sum("count").over(whole))


def wind_rose(df: DataFrame, keys: list[str], speed: str, direction: str, edges: list[float], sectors: int = 16) -> DataFrame:
    """Share in percent of each sector and speed class; sectors are centred on north."""
    width = 360.0 / sectors
    sector = F.pmod(F.floor((F.col(direction) + width / 2) / width), F.lit(sectors)).cast("int")
    level = sum(((F.col(speed) >= e).cast("int") for e in edges[1:]), F.lit(0))
    got = df.groupBy(*keys, sector.alias("sector"), level.alias("speed_class")).agg(F.count("*").alias("n"))
    return got.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def month_weighted(df: DataFrame, keys: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """Annual means of monthly values, weighted by the months' days."""
    days = F.dayofmonth(F.last_day(F.col(time)))
    held = F.when(F.col(value).isNotNull(), days)
    return df.groupBy(*keys, F.year(time).alias("year")).agg((F.sum(F.col(value) * days) / F.sum(held)).alias(value))


def area_mean(df: DataFrame, keys: list[str], lat: str = "lat", value: str = "value") -> DataFrame:
    """Means weighted by the cosine of latitude."""
    w = F.cos(F.radians(lat))
    return df.groupBy(*keys).agg((F.sum(F.col(value) * w) / F.sum(F.when(F.col(value).isNotNull(), w))).alias(value))


def mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value, the least one on ties, with its count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct((-F.col("n")).alias("a"), F.col(column).alias("b"))).alias(column), F.max("n").alias("n"))


def arg_extremes(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Where the least and the largest value are; the first place on ties."""
    order = F.struct(F.col(value).alias("v"), F.col(at).alias("t"))
    back = F.struct((-F.col(value)).alias("v"), F.col(at).alias("t"))
    held = df.where(F.col(value).isNotNull())
    return held.groupBy(*keys).agg(F.min_by(at, order).alias("argmin"), F.min_by(at, back).alias("argmax"))


def audit(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    missing = F.count_if(F.col(value).isNull())
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), missing.alias("missing"), (100.0 * missing / F.count("*")).alias("missing_pct"))


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def equal_gcm_mean(df: DataFrame, keys: list[str], gcm: str = "gcm", value: str = "value") -> DataFrame:
    """Members are averaged within their model first, so that every model weighs the same."""
    return df.groupBy(*keys, gcm).agg(F.avg(value).alias(value)).groupBy(*keys).agg(F.avg(value).alias(value))


def with_ensemble_rows(df: DataFrame, keys: list[str], sim: str = "sim", value: str = "value", stats=("mean", "min", "max", "median")) -> DataFrame:
    """Appends a series for each statistic over the simulations."""
    got = df.groupBy(*keys).agg(*[METRICS[s](value).alias(s) for s in stats])
    long = got.unpivot(keys, list(stats), sim, value)
    return df.select(*keys, sim, value).unionByName(long.select(*keys, sim, value))


def spread(df: DataFrame, keys: list[str], value: str = "value", std_floor: float = 0.01, mean_floor: float = 0.05) -> DataFrame:
    """Range, sign agreement in percent, signal to noise, variation, quartile and decile ranges over the simulations."""
    q = F.percentile(value, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    got = df.groupBy(*keys).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (100.0 * F.count_if(F.col(value) > 0) / F.count("*")).alias("agree_pct"), q.alias("q"))
    return got.select(
        *keys, (F.col("hi") - F.col("lo")).alias("range"), "agree_pct",
        (F.col("mean") / F.greatest("std", F.lit(std_floor))).alias("snr"),
        (F.col("std") / F.greatest(F.abs("mean"), F.lit(mean_floor))).alias("cv"),
        (F.col("q")[3] - F.col("q")[1]).alias("iqr"), (F.col("q")[4] - F.col("q")[0]).alias("p10_p90"),
        F.try_divide(F.col("q")[3] - F.col("q")[1], F.abs(F.col("q")[2])).alias("iqr_ratio"),
    )


def first_crossing(df: DataFrame, keys: list[str], level, at: str = "year", value: str = "value") -> DataFrame:
    """The first `at` whose value is above level, NULL if none is."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(value) > level, F.col(at))).alias("crossing"))


def horizon_means(df: DataFrame, horizons: list[tuple[str, int, int]], keys: list[str], year: str = "year", value: str = "value", sim: str = "sim") -> DataFrame:
    """Mean of each horizon with the simulations' least and largest mean and one deviation to each side."""
    spark = df.sparkSession
    h = spark.createDataFrame(horizons, "horizon string, first int, last int")
    per_sim = df.join(F.broadcast(h), F.col(year).between(F.col("first"), F.col("last"))).groupBy(*keys, "horizon", sim).agg(F.avg(value).alias("m"))
    return per_sim.groupBy(*keys, "horizon").agg(F.avg("m").alias("mean"), F.min("m").alias("lo"), F.max("m").alias("hi"), (F.avg("m") - F.stddev_pop("m")).alias("lo_std"), (F.avg("m") + F.stddev_pop("m")).alias("hi_std"))
