"""Global warming levels: crossings, windows around them, lookups either way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import in_windows


def crossings(trajectory: DataFrame, levels: list[float], keys: list[str], year: str = "year", value: str = "value") -> DataFrame:
    """First year above each level, NULL if never: (keys, warming_level, crossing)."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("warming_level")
    return trajectory.select(*keys, year, value, at).groupBy(*keys, "warming_level").agg(F.min(F.when(F.col(value) > F.col("warming_level"), F.col(year))).alias("crossing"))


def window_around(df: DataFrame, crossing: DataFrame, keys: list[str], half: int = 15, time: str = "time", months: list[int] | None = None, dummy_time: bool = False) -> DataFrame:
    """Rows in [crossing - half, crossing + half) years of each level, with time_delta (signed step from the window's middle) and centred_year.

    Window functions run on the whole window before months are filtered. dummy_time adds a calendar that starts with 2000-01-01 for every series."""
    spans = crossing.where("crossing is not null").select(*keys, "warming_level", F.col("crossing").alias("centred_year"), F.make_date(F.col("crossing") - half, F.lit(1), F.lit(1)).alias("__first"), F.make_date(F.col("crossing") + half, F.lit(1), F.lit(1)).alias("__last"))
    rows = in_windows(df, spans, keys, time, "__first", "__last")
    series = Window.partitionBy(*keys, "warming_level")
    rows = rows.withColumn("__n", F.row_number().over(series.orderBy(time)) - 1)
    rows = rows.withColumn("time_delta", (F.col("__n") - F.floor(F.count("*").over(series) / 2)).cast("int"))
    if dummy_time:
        rows = rows.withColumn("dummy_time", F.date_add(F.lit("2000-01-01").cast("date"), F.col("__n").cast("int")))
    if months:
        rows = rows.where(F.month(time).isin(months))
    return rows.drop("__n", "__first", "__last")


def year_at_level(trajectory: DataFrame, level: float, scenario: str | None = None, fallback: str = "Historical") -> DataFrame:
    """Best estimate and range of the first year above a level; the upper bound of temperature crosses first. History counts before a scenario."""
    own = trajectory if scenario is None else trajectory.where(F.col("scenario").isin(scenario, fallback))
    first = lambda c: F.min(F.when(F.col(c) > level, F.col("year")))
    return own.groupBy(*([F.lit(scenario).alias("scenario")] if scenario else ["scenario"])).agg(first("mean").alias("best"), first("p95").alias("earliest"), first("p5").alias("latest"))


def level_at_year(trajectory: DataFrame, year: int) -> DataFrame:
    return trajectory.where(F.col("year") == year).select("scenario", "year", "p5", "mean", "p95")


def simulations_at(crossing: DataFrame, level: float | None = None, year: int | None = None) -> DataFrame:
    """Histogram over the simulations of the crossing years of a level, or of the highest level reached by a year."""
    if (level is None) == (year is None):
        raise ValueError("give a level or a year")
    if level is not None:
        return crossing.where((F.col("warming_level") == level) & F.col("crossing").isNotNull()).groupBy("crossing").agg(F.count("*").alias("simulations"))
    reached = crossing.groupBy("sim").agg(F.max(F.when(F.col("crossing") <= year, F.col("warming_level"))).alias("reached"))
    return reached.groupBy("reached").agg(F.count("*").alias("simulations"))
