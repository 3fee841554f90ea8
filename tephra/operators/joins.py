"""Joins on labelled dimensions: aligned arithmetic, merges, lookups, intervals, nearest neighbours, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aligned(a: DataFrame, b: DataFrame, keys: list[str], how, value: str = "value", out: str = "value") -> DataFrame:
    """Arithmetic on the coordinates that both have; how takes the two values."""
    joined = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys)
    return joined.select(*keys, how(F.col("__a"), F.col("__b")).alias(out))


def merge(variables: dict[str, DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """One column for each variable on the union of their coordinates: one shuffle, no chain of outer joins."""
    out = None
    for name, df in variables.items():
        df = df.select(*keys, F.lit(name).alias("__variable"), F.col(value).alias("__value"))
        out = df if out is None else out.unionByName(df)
    return out.groupBy(*keys).pivot("__variable", list(variables)).agg(F.first("__value", ignorenulls=True))


def minus_climatology(df: DataFrame, climatology: DataFrame, keys: list[str], value: str = "value", out: str = "anomaly") -> DataFrame:
    return df.join(climatology.withColumnRenamed(value, "__clim"), keys).withColumn(out, F.col(value) - F.col("__clim")).drop("__clim")


def lookup(df: DataFrame, dimension: DataFrame, on: list[str], required: bool = True) -> DataFrame:
    """Join with a dimension table; Spark broadcasts it if its measured size is below the session's threshold."""
    return df.join(dimension, on, "inner" if required else "left")


def in_windows(df: DataFrame, windows: DataFrame, keys: list[str], time: str = "time", first: str = "first", last: str = "last") -> DataFrame:
    """Rows within a window of their series: first <= time < last. Equality on the keys keeps it from being a theta join."""
    return df.join(windows, keys).where((F.col(time) >= F.col(first)) & (F.col(time) < F.col(last)))


def in_bins(df: DataFrame, windows: DataFrame, value: str, width: float, first: str = "first", last: str = "last") -> DataFrame:
    """Interval join without an equality: windows are dealt to bins of `width`, rows to their bin, then both meet in an equi-join."""
    slot = F.floor(F.col(value) / width)
    dealt = windows.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    return df.withColumn("__bin", slot).join(dealt, "__bin").where((F.col(value) >= F.col(first)) & (F.col(value) < F.col(last))).drop("__bin")


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def nearest_cell(points: DataFrame, cells: DataFrame, point_key: str, cell_key: str, reach: float, only: Column | None = None) -> DataFrame:
    """The nearest cell of each point (lat, lon columns) by squared degrees, ties to the lesser key; only restricts the cells, to land say.

    Cells are dealt to squares of `reach` degrees and points ask the nine squares around them, so both sides meet by equality.
    A point with no cell within reach has no row."""
    cells = cells if only is None else cells.where(only)
    square = lambda c: F.floor(F.col(c) / reach).cast("long")
    around = F.sequence(F.lit(-1), F.lit(1))
    p = points.select(point_key, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), square("lat").alias("__y"), square("lon").alias("__x"))
    p = p.withColumn("__y", F.explode(F.transform(around, lambda d: F.col("__y") + d))).withColumn("__x", F.explode(F.transform(around, lambda d: F.col("__x") + d)))
    c = cells.select(cell_key, "lat", "lon", square("lat").alias("__y"), square("lon").alias("__x"))
    near = p.join(c, ["__y", "__x"]).withColumn("d2", F.pow(F.col("lat") - F.col("p_lat"), F.lit(2)) + F.pow(F.col("lon") - F.col("p_lon"), F.lit(2)))
    near = near.where((F.abs(F.col("lat") - F.col("p_lat")) <= reach) & (F.abs(F.col("lon") - F.col("p_lon")) <= reach))
    best = F.struct("d2", F.col(cell_key).alias("k"))
    return near.groupBy(point_key).agg(F.min(best).alias("b")).select(point_key, F.col("b.k").alias(cell_key), F.col("b.d2").alias("d2"))


def nearest_in_time(df: DataFrame, moments: DataFrame, keys: list[str], moment: str = "moment", time: str = "time", value: str = "value") -> DataFrame:
    """The value nearest in time to each moment of a series, the earlier one on ties."""
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col(moment).cast("timestamp")))
    joined = df.join(moments, keys)
    return joined.groupBy(*keys, moment).agg(F.min_by(value, F.struct(gap.alias("g"), F.col(time).alias("t"))).alias(value), F.min_by(time, F.struct(gap.alias("g"), F.col(time).alias("t"))).alias("at"))


def keep_common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def keep_missing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def history_with_scenarios(df: DataFrame, keys: list[str], history: str = "historical", scenario: str = "scenario") -> DataFrame:
    """Each scenario's rows with the historical rows of the same model and member before them; members without both are skipped."""
    past, future = df.where(F.col(scenario) == history), df.where(F.col(scenario) != history)
    pairs = future.select(*keys, scenario).distinct().join(past.select(*keys).distinct(), keys, "left_semi")
    front = past.drop(scenario).join(pairs, keys)
    back = future.join(pairs, [*keys, scenario], "left_semi")
    return front.withColumn("segment", F.lit("historical")).unionByName(back.withColumn("segment", F.lit("scenario")))
