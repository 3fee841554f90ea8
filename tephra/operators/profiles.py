"""Typical-year profiles: standard years, medoid years, median years, typical meteorological years, ramps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import bins


def standard_year(df: DataFrame, keys: list[str], q: float = 0.5, hour: str = "hour_of_year", value: str = "value") -> DataFrame:
    """Quantile over the years of each hour of the year."""
    return df.where(F.col(hour).isNotNull()).groupBy(*keys, hour).agg(F.percentile(value, F.lit(q)).alias(value))


def profile_delta(profile: DataFrame, reference: DataFrame, keys: list[str], hour: str = "hour_of_year", value: str = "value") -> DataFrame:
    return profile.join(reference.select(*keys, hour, F.col(value).alias("__ref")), [*keys, hour]).withColumn("delta", F.col(value) - F.col("__ref")).drop("__ref")


def medoid_year(df: DataFrame, keys: list[str], year: str = "year", steps: tuple[str, ...] = ("doy", "hour"), value: str = "value") -> DataFrame:
    """The year whose values lie nearest, in the root of the summed squares, to the medians over the years at each step; the first one on ties."""
    median = df.groupBy(*keys, *steps).agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    apart = df.join(median, [*keys, *steps]).groupBy(*keys, year).agg(F.sqrt(F.sum(F.pow(F.col(value) - F.col("__m"), F.lit(2.0)))).alias("distance"))
    return apart.groupBy(*keys).agg(F.min(F.struct("distance", year)).alias("b")).select(*keys, F.col(f"b.{year}").alias(year), F.col("b.distance").alias("distance"))


def finkelstein_schafer(df: DataFrame, keys: list[str], indices: dict[str, float], edges: dict[str, tuple[float, float]], n: int = 20, skip_years: tuple[int, ...] = (), time: str = "time") -> DataFrame:
    """(keys, month, year, score): weighted mean distance between a month's distribution and that of the month in all years, for each index.

    df has daily rows with a column for each index. Distributions are histograms on common edges."""
    long = df.withColumn("year", F.year(time)).withColumn("month", F.month(time)).unpivot([*keys, "year", "month"], list(indices), "index", "value")
    bin_of = F.coalesce(*[F.when(F.col("index") == i, bins(F.col("value"), *edges[i], n)) for i in indices])
    counts = long.withColumn("bin", bin_of).where("bin is not null").groupBy(*keys, "index", "month", "year", "bin").agg(F.count("*").alias("c"))
    grid = counts.select(*keys, "index", "month", "year").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dense = grid.join(counts, [*keys, "index", "month", "year", "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    own = Window.partitionBy(*keys, "index", "month", "year")
    dense = dense.withColumn("f", F.sum("c").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("c").over(own))
    every = dense.groupBy(*keys, "index", "month", "bin").agg(F.sum("c").alias("c"))
    all_years = Window.partitionBy(*keys, "index", "month")
    every = every.withColumn("g", F.sum("c").over(all_years.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("c").over(all_years)).drop("c")
    fs = dense.join(every, [*keys, "index", "month", "bin"]).groupBy(*keys, "index", "month", "year").agg(F.avg(F.abs(F.col("f") - F.col("g"))).alias("fs"))
    weight = F.coalesce(*[F.when(F.col("index") == i, F.lit(float(w))) for i, w in indices.items()])
    scores = fs.groupBy(*keys, "month", "year").agg(F.sum(weight * F.col("fs")).alias("score"))
    return scores.where(~F.col("year").isin(list(skip_years))) if skip_years else scores


def typical_months(scores: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    """The n best candidate years of each month, by score then year."""
    w = Window.partitionBy(*keys, "month").orderBy("score", "year")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def stitch(hourly: DataFrame, chosen: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """The hours of each month's chosen year."""
    rows = hourly.withColumn("month", F.month(time)).withColumn("year", F.year(time))
    return rows.join(chosen.where("rank = 1").select(*keys, "month", "year"), [*keys, "month", "year"], "left_semi")


def insert_event(profile: DataFrame, event: DataFrame, keys: list[str], at: int, half: int = 24, kind: str = "max", hour: str = "hour_of_year", value: str = "value", event_value: str = "return_value") -> DataFrame:
    """Ramps a profile linearly up (or down) to an event's value at hour `at` over `half` hours to each side.

    A max event never lowers the profile, a min event never raises it; applying it to its own result inserts a second event."""
    weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col(hour) - at) / F.lit(float(half)))
    mixed = F.col(value) + weight * (F.col("__event") - F.col(value))
    extreme = F.greatest if kind == "max" else F.least
    joined = profile.join(event.select(*keys, F.col(event_value).alias("__event")), keys, "left")
    return joined.withColumn(value, F.coalesce(extreme(F.col(value), mixed), F.col(value))).drop("__event")


def degree_days_of_profile(profile: DataFrame, keys: list[str], base: float, hour: str = "hour_of_year", value: str = "value") -> DataFrame:
    """Cooling degree days from a profile's daily means."""
    daily = profile.groupBy(*keys, F.floor(F.col(hour) / 24).alias("day")).agg(F.avg(value).alias("mean"))
    return daily.groupBy(*keys).agg(F.sum(F.greatest(F.col("mean") - base, F.lit(0.0))).alias("cdd"))
