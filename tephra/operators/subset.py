"""Subsetting: labels, positions, times, boxes, points, masks, sets; also set operations, sorting and reshaping of long tables."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMATS = (("%Y", "year"), ("%Y-%m", "month"), ("%B %Y", "month"), ("%b %Y", "month"), ("%Y-%m-%d", "day"), ("%Y-%m-%d %H", "hour"), ("%Y-%m-%d %H:%M", "minute"), ("%Y-%m-%d %H:%M:%S", "second"))


def span(text: str) -> tuple[datetime, datetime]:
    """First moment of a partial date and first moment after it."""
    for form, unit in FORMATS:
        try:
            at = datetime.strptime(text.strip(), form)
        except ValueError:
            continue
        if unit == "year":
            return at, at.replace(year=at.year + 1)
        if unit == "month":
            return at, (at.replace(day=28) + timedelta(days=4)).replace(day=1)
        return at, at + {"day": timedelta(days=1), "hour": timedelta(hours=1), "minute": timedelta(minutes=1), "second": timedelta(seconds=1)}[unit]
    raise ValueError(f"not a date: {text!r}")


def _ntz(at: datetime) -> Column:
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def time_slice(df: DataFrame, first: str | int | None, last: str | int | None = None, time: str = "time") -> DataFrame:
    """Rows from first to last, both included to the end of what the partial dates name. One date selects what it names."""
    last = first if last is None else last
    out, t = df, F.col(time).cast("timestamp_ntz")
    if df.schema[time].dataType.simpleString() == "timestamp_ntz":
        t = F.col(time)  # so that the filter reaches the scan
    if first is not None:
        out = out.where(t >= _ntz(span(str(first))[0]))
    if last is not None:
        out = out.where(t < _ntz(span(str(last))[1]))
    return out


def box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Works for regular and curvilinear grids alike, since latitude and longitude are columns."""
    return df.where(F.col("lat").between(min(lat), max(lat)) & F.col("lon").between(min(lon), max(lon)))


def nth(df: DataFrame, keys: list[str], positions: list[int] | None = None, stride: int | None = None, time: str = "time") -> DataFrame:
    """Rows at zero-based positions along time, or every stride-th one."""
    df = df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)
    keep = F.col("__at").isin(positions) if positions is not None else F.col("__at") % stride == 0
    return df.where(keep).drop("__at")


def date_parts(df: DataFrame, months: list[int] | None = None, hours: list[int] | None = None, leap_day: bool = True, time: str = "time") -> DataFrame:
    t = F.col(time)
    if months:
        df = df.where(F.month(t).isin(months))
    if hours:
        df = df.where(F.hour(t).isin(hours))
    return df if leap_day else df.where(~((F.month(t) == 2) & (F.dayofmonth(t) == 29)))


def mask(value: Column, keep: Column) -> Column:
    """Keeps the row, drops the value."""
    return F.when(keep, value)


def live_series(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Without the series that hold no value at all."""
    held = df.groupBy(*keys).agg(F.count(value).alias("__n")).where("__n > 0").drop("__n")
    return df.join(held, keys, "left_semi")


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first in a stated order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def local_time(df: DataFrame, zone: str | Column, time: str = "time", reindex: bool = False) -> DataFrame:
    """UTC to local clock time, of one zone or of the zone in a column; with reindex, trimmed to the range that the UTC times had."""
    t = F.col(time).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    out = df.withColumn("__utc", t).withColumn(time, local)
    if reindex:
        out = out.where(F.col(time).between(df.select(F.min(t)).scalar(), df.select(F.max(t)).scalar()))
    return out.drop("__utc")


def complete_windows(df: DataFrame, excluded: DataFrame, on: list[str]) -> DataFrame:
    """Without the simulations whose window around a warming level is incomplete."""
    return df.join(excluded.select(*on).distinct(), on, "left_anti")


def relational_division(df: DataFrame, key: str, column: str, values: list) -> DataFrame:
    """The keys that have every one of the values."""
    return df.where(F.col(column).isin(values)).groupBy(key).agg(F.countDistinct(column).alias("__n")).where(F.col("__n") == len(set(values))).select(key)


def update_at(df: DataFrame, updates: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Replaces the values that an updates table names."""
    new = updates.select(*on, F.col(value).alias("__new"))
    return df.join(new, on, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def union_all(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Frames under one another by column name, missing columns NULL, with a column that says where a row is from."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def with_last_of(history: DataFrame, future: DataFrame, keys: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """Puts each series' last historical step before its future."""
    last = history.groupBy(*keys).agg(F.max(time).alias(time), F.max_by(value, time).alias(value))
    return future.select(*keys, time, value).unionByName(last.select(*keys, time, value).join(future.select(*keys).distinct(), keys, "left_semi"))


def joined_calendar(baseline: DataFrame, future: DataFrame, keys: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """Baseline then future as one run of steps: step counts from 0, segment says which part a row is of."""
    both = union_all({"baseline": baseline.select(*keys, time, value), "future": future.select(*keys, time, value)}, "segment")
    w = Window.partitionBy(*keys).orderBy("segment", time)
    return both.withColumn("step", F.row_number().over(w) - 1)


def pick_simulations(df: DataFrame, sim: str, metric: str, middle: float = 0.1) -> DataFrame:
    """Labels simulations by their metric: min, max, median, q25, q75 (nearest rank) and those in the middle share.

    df has a row for each simulation."""
    w = Window.orderBy(metric, sim)
    ranked = df.withColumn("place", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    at = {"min": F.lit(1), "q25": F.ceil(F.col("n") * 0.25), "median": F.ceil(F.col("n") * 0.5), "q75": F.ceil(F.col("n") * 0.75), "max": F.col("n")}
    labels = F.array(*[F.when(F.col("place") == p, F.lit(k)) for k, p in at.items()], F.when(F.abs((F.col("place") - 0.5) / F.col("n") - 0.5) <= middle / 2, F.lit("middle")))
    return ranked.select(sim, metric, F.explode(F.array_compact(labels)).alias("label"))


def expand_name(name: str) -> str:
    """File-safe form of a name."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name.strip())


def insert_at(df: DataFrame, position: int, name: str, value: Column) -> DataFrame:
    """df with a new column at a position from 0; one of that name moves there."""
    rest = [F.col(c) for c in df.columns if c != name]
    return df.select(*rest[:position], value.alias(name), *rest[position:])
