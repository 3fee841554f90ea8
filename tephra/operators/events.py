"""Threshold, compound and run-length events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import beyond
from . import windows as W
from .joins import minus_climatology


def wind_and_rain(df: DataFrame, keys: list[str], rain_above: float, wind_above: float, duration: int, years: float, time: str = "time", rain: str = "rain", wind: str = "wind") -> DataFrame:
    """Yearly rates of days with much rain over `duration` days, of windy days, of both within the same days, and of windy spells."""
    wet = beyond(W.rolling("sum", F.col(rain), duration, keys, time), rain_above)
    windy = beyond(F.col(wind), wind_above)
    df = df.withColumn("__wet", wet).withColumn("__windy", windy).withColumn("__spell", W.rolling_any(F.col(wind) > wind_above, duration, keys, time))
    rate = lambda c: F.sum(F.expr(c).cast("int")) / F.lit(float(years))
    return df.groupBy(*keys).agg(rate("__wet").alias("wet"), rate("__windy").alias("windy"), rate("__spell").alias("windy_spell"), rate("__wet AND __spell").alias("compound"))


def compound_count(df: DataFrame, keys: list[str], by: list[str], rain_above: float, wind_above: float, duration: int, time: str = "time", rain: str = "rain", wind: str = "wind") -> DataFrame:
    """For each of `by` (a day, say) in how many cells much rain over `duration` days met a windy spell, and how many cells have both values."""
    wet = beyond(W.rolling("sum", F.col(rain), duration, keys, time), rain_above)
    flagged = df.withColumn("__both", wet & W.rolling_any(F.col(wind) > wind_above, duration, keys, time))
    return flagged.groupBy(*by).agg(F.count_if("__both").alias("compound_count"), F.count_if(F.col(rain).isNotNull() & F.col(wind).isNotNull()).alias("cells"))


def hot_and_calm(df: DataFrame, keys: list[str], hot: float, warm_night: float, calm: float, years: float, tmax: str = "tmax", tmin: str = "tmin", wind: str = "wind") -> DataFrame:
    """Yearly rate of days that are hot, end in a warm night and have little wind."""
    flag = beyond(F.col(tmax), hot) & beyond(F.col(tmin), warm_night) & beyond(F.col(wind), calm, "<")
    return df.groupBy(*keys).agg((F.sum(flag.cast("int")) / F.lit(float(years))).alias("rate"), F.avg(flag.cast("double")).alias("share"))


def hot_and_calm_site(df: DataFrame, wind: DataFrame, by: list[str], hot: float, warm_night: float, calm: float, time: str = "time", cell: str = "cell", tmax: str = "tmax", tmin: str = "tmin") -> DataFrame:
    """For each day of `by` the cells that are hot, that end in a warm night and that are both on a day with little wind at the site, of the cells with values.

    wind: rows (by, time, wind) of the site's cells; the site's wind is their mean, joined by day."""
    site = wind.groupBy(*by, time).agg(F.avg("wind").alias("site_wind"))
    is_hot, is_warm, is_calm = beyond(F.col(tmax), hot), beyond(F.col(tmin), warm_night), beyond(F.col("site_wind"), calm, "<")
    held = F.col(tmax).isNotNull() & F.col(tmin).isNotNull()
    count = lambda flag, name: F.count_if(held & flag).alias(name)
    return df.join(site, [*by, time], "left").groupBy(*by, time).agg(F.count_if(held).alias("cells"), count(is_hot, "hot"), count(is_warm, "warm"), F.max(F.coalesce(is_calm, F.lit(False))).alias("calm"), count(is_hot & is_warm & is_calm, "compound"))


def cell_rates(daily: DataFrame, by: list[str], years: float) -> DataFrame:
    """Yearly rates for a cell, on average, of the daily counts of `hot_and_calm_site`."""
    part = lambda c: F.try_divide(F.sum(c), F.max("cells")) / F.lit(float(years))
    return daily.groupBy(*by).agg(part("hot").alias("hot_rate"), part("warm").alias("warm_rate"), (F.count_if("calm") / F.lit(float(years))).alias("calm_rate"), part("compound").alias("compound_rate"))


def spatial_condition(df: DataFrame, keys: list[str], flag, share: float = 0.5, value: str = "value") -> DataFrame:
    """Whether at least `share` of the cells with a value have the flag, for each key."""
    f = F.coalesce(flag, F.lit(False))
    part = F.try_divide(F.count_if(f & F.col(value).isNotNull()), F.count(value))
    return df.groupBy(*keys).agg(part.alias("fraction"), F.coalesce(part >= share, F.lit(False)).alias("hit"))


def climate_state(df: DataFrame, keys: list[str], baseline: tuple[int, int], window: int, run: int, low: float = 0.25, high: float = 0.75, time: str = "time", value: str = "value") -> DataFrame:
    """Monthly anomalies from the baseline's monthly median, their rolling median, the baseline's quantiles of it, and hits: +1 in runs of `run` or more
    months above the upper one, -1 in those below the lower one, else 0. df is monthly."""
    inside = F.year(time).between(*baseline)
    clim = df.where(inside).groupBy(*keys, F.month(time).alias("month")).agg(F.percentile(value, F.lit(0.5)).alias(value))
    anomaly = minus_climatology(df.withColumn("month", F.month(time)), clim, [*keys, "month"], value)
    smooth = anomaly.withColumn("smooth", W.rolling("median", F.col("anomaly"), window, keys, time))
    limits = smooth.where(inside).groupBy(*keys).agg(F.percentile("smooth", F.lit(low)).alias("lo"), F.percentile("smooth", F.lit(high)).alias("hi"))
    joined = smooth.join(limits, keys)
    return W.run_hits(joined, beyond(F.col("smooth"), F.col("hi")), beyond(F.col("smooth"), F.col("lo"), "<"), run, keys, time)


def find_events(df: DataFrame, keys: list[str], threshold, direction: str, duration: int, time: str = "time", value: str = "value", whole_run: bool = False) -> DataFrame:
    """Marks events of `duration` steps beyond a threshold: their first step, or with whole_run every step. threshold: a number or a table (keys, threshold)."""
    if isinstance(threshold, DataFrame):
        df, level = df.join(threshold, keys), F.col("threshold")
    else:
        level = F.lit(float(threshold))
    flag = beyond(F.col(value), level, direction)
    if whole_run:
        return W.run_hits(df, flag, F.lit(False), duration, keys, time)
    return df.withColumn("hit", W.starts_of(flag, duration, keys, time).cast("int"))


def stress_events(df: DataFrame, statewide: DataFrame, hot: float, warm: float, days: int = 3, share: float = 0.5, mask: DataFrame | None = None, sim: str = "sim", cell: str = "cell", time: str = "time") -> DataFrame:
    """Days on which the statewide condition holds and, in `share` of the cells, `days` days in a row were hot and `days` nights warm.

    Only cells with a value count: those without (sea, outside a region) are no cells of the condition. mask: a table of the cells that may count at all."""
    keys = [sim, cell]
    if mask is not None:
        df = df.join(mask.select(cell).distinct(), cell, "left_semi")
    flagged = df.withColumn("__hot", W.consecutive(F.col("tmax") > hot, days, keys, time)).withColumn("__warm", W.consecutive(F.col("tmin") > warm, days, keys, time))
    part = lambda flag, value: F.coalesce(F.try_divide(F.count_if(F.col(flag) & F.col(value).isNotNull()), F.count(value)) >= share, F.lit(False))
    spatial = flagged.groupBy(sim, time).agg(part("__hot", "tmax").alias("hot"), part("__warm", "tmin").alias("warm"))
    return spatial.join(statewide.select(sim, time, "hit"), [sim, time]).where("hot and warm and hit").select(sim, time)


def yearly_rate(events: DataFrame, keys: list[str], years: float) -> DataFrame:
    """Events a year for each key that has any."""
    return events.groupBy(*keys).agg((F.count("*") / F.lit(float(years))).alias("rate"))


def exceedance_counts(df: DataFrame, keys: list[str], threshold: float, direction: str = ">", duration: int = 1, period: str = "year", smooth: int = 1, time: str = "time", value: str = "value") -> DataFrame:
    """Counts of steps that end `duration` steps beyond the threshold, by period, with a trailing mean over `smooth` periods."""
    df = df.withColumn("__hit", W.consecutive(beyond(F.col(value), threshold, direction), duration, keys, time))
    counts = df.groupBy(*keys, F.date_trunc(period, F.col(time)).cast("date").alias("period")).agg(F.count_if("__hit").alias("count"))
    return counts.withColumn("smoothed", W.rolling("mean", F.col("count"), smooth, keys, "period"))


def climate_signal(df: DataFrame, keys: list[str], baseline: float, future: float, relative: bool = False, level: str = "warming_level", value: str = "value") -> DataFrame:
    """Change of the mean over space and time between two warming levels, absolute or in percent."""
    mean = lambda x: F.avg(F.when(F.col(level) == x, F.col(value)))
    got = df.groupBy(*keys).agg(mean(baseline).alias("base"), mean(future).alias("then"))
    change = F.try_divide(100.0 * (F.col("then") - F.col("base")), F.col("base")) if relative else F.col("then") - F.col("base")
    return got.withColumn("signal", change)
