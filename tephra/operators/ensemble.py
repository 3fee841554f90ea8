"""Uncertainty over ensembles: variance decomposition, scenario against model spread, density estimates, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W


def variance_parts(df: DataFrame, sim: str = "sim", gcm: str = "gcm", scenario: str = "scenario", year: str = "year", value: str = "value", smooth: int = 10) -> DataFrame:
    """(year, internal, model, scenario_var, total and the three fractions) of yearly anomalies.

    internal: variance over all simulations, averaged over years and scenarios; model: variance over models of their member means, averaged over
    scenarios; scenario: variance over scenarios of the simulations' mean. Means run over `smooth` years first."""
    keys = [scenario, gcm, sim]
    smoothed = df.withColumn("v", W.rolling("mean", F.col(value), smooth, keys, year)).where("v is not null")
    internal = smoothed.groupBy(scenario, year).agg(F.var_pop("v").alias("x")).agg(F.avg("x").alias("internal"))
    models = smoothed.groupBy(scenario, gcm, year).agg(F.avg("v").alias("m")).groupBy(scenario, year).agg(F.var_pop("m").alias("x")).groupBy(year).agg(F.avg("x").alias("model"))
    scenarios = smoothed.groupBy(scenario, year).agg(F.avg("v").alias("m")).groupBy(year).agg(F.var_pop("m").alias("scenario_var"))
    out = models.join(scenarios, year).withColumn("internal", internal.scalar())
    total = F.col("internal") + F.col("model") + F.col("scenario_var")
    out = out.withColumn("total", total)
    return out.withColumns({f"{c}_fraction": F.try_divide(F.col(c), F.col("total")) for c in ("internal", "model", "scenario_var")})


def scenario_against_model(df: DataFrame, smooth: int = 10, min_periods: int = 5, scenario: str = "scenario", sim: str = "sim", year: str = "year", value: str = "value") -> DataFrame:
    """(year, s, m, fraction): sample variance of the scenarios' multi-model means, mean of the models' variance within scenarios, both smoothed by
    a centred mean, and s / (s + m)."""
    by = df.groupBy(scenario, year).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    raw = by.groupBy(year).agg(F.var_samp("mean").alias("s"), F.avg("var").alias("m")).withColumn("__all", F.lit(1))
    out = raw.select(year, *[W.rolling("mean", F.col(c), smooth, ["__all"], year, min_periods, center=True).alias(c) for c in ("s", "m")])  # a row for each year
    total = F.col("s") + F.col("m")
    return out.withColumn("fraction", F.when(total > 0, F.col("s") / total))


def crossover(parts: DataFrame, year: str = "year") -> DataFrame:
    """First year in which scenarios differ more than models do."""
    return parts.agg(F.min(F.when(F.col("s") > F.col("m"), F.col(year))).alias("crossover"))


def density(df: DataFrame, keys: list[str], low: float, high: float, points: int = 300, factor: float = 0.5, value: str = "value") -> DataFrame:
    """Gaussian kernel density on a grid, scaled to a maximum of 1; the bandwidth is factor times the sample's deviation.

    Equal values are counted once, so the grid meets distinct values only. Quotients of nothing by nothing are NaN: if the grid lies so far from all values
    (some 38 bandwidths) that every sum is 0, and at a value without any deviation. A single value has no deviation and NULL as density."""
    counted = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    width = df.groupBy(*keys).agg((F.stddev_samp(value) * factor).alias("h"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    step = (high - low) / (points - 1)
    rows = counted.join(width, keys).select("*", grid).withColumn("x", F.lit(low) + F.col("i") * step)
    nan = F.lit(float("nan"))
    flat = F.when(F.col("x") == F.col("v"), nan).otherwise(0.0)
    kernel = F.when(F.col("h") == 0, flat).otherwise(F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), F.lit(2.0))))
    d = rows.groupBy(*keys, "i", "x").agg(F.sum(F.col("n") * kernel).alias("d")).withColumn("__top", F.max("d").over(Window.partitionBy(*keys)))
    return d.withColumn("density", F.when(F.col("__top") == 0, nan).otherwise(F.col("d") / F.col("__top"))).drop("d", "__top")


def gcm_ranges(df: DataFrame, keys: list[str], gcm: str = "gcm", value: str = "value") -> DataFrame:
    return df.groupBy(*keys, gcm).agg(F.max(value).alias("max"), F.min(value).alias("min"), F.percentile(value, F.lit(0.5)).alias("median"))


def pooled_and_mean_quantiles(df: DataFrame, sim: str, q: float, value: str = "value") -> DataFrame:
    """The quantile of all values together beside the mean of the simulations' own quantiles."""
    own = df.groupBy(sim).agg(F.percentile(value, F.lit(q)).alias("q")).agg(F.avg("q"))
    return df.agg(F.percentile(value, F.lit(q)).alias("pooled")).withColumn("mean_of_sims", own.scalar())


def common_models(df: DataFrame, scenarios: list[str], gcm: str = "gcm", scenario: str = "scenario") -> DataFrame:
    """Rows of the models that have every one of the scenarios."""
    full = df.where(F.col(scenario).isin(scenarios)).groupBy(gcm).agg(F.countDistinct(scenario).alias("__n")).where(F.col("__n") == len(scenarios)).select(gcm)
    return df.where(F.col(scenario).isin(scenarios)).join(full, gcm, "left_semi")


def largest_models(df: DataFrame, models: int = 7, members: int = 4, gcm: str = "gcm", member: str = "member") -> DataFrame:
    """The models with most members, and the first members of each."""
    pairs = df.select(gcm, member).distinct()
    count = pairs.groupBy(gcm).agg(F.count("*").alias("n")).orderBy(F.desc("n"), gcm).limit(models)
    first = F.row_number().over(Window.partitionBy(gcm).orderBy(member))
    return pairs.join(count, gcm).withColumn("place", first).where(F.col("place") <= members).select(gcm, member, "n", "place")
