"""Block extremes and what fits of them tell: return values, probabilities, periods, goodness of fit, differences of samples.

A series of block extremes is short (one value for a block), so fits run in one grouped call for each series. The default fit, GEV by L-moments, is a
plain aggregation and stays in the JVM."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fits
from ..functions.weather import log_gamma
from . import windows as W


def block_extremes(df: DataFrame, keys: list[str], kind: str = "max", duration: int = 1, per_day: bool = False, grouped: int = 1, block_years: int = 1, time: str = "time", value: str = "value") -> DataFrame:
    """(keys, block, value): the extreme of each block of years. An event may last `duration` steps (the least value of a max event's steps counts), be
    reduced to a value a day, and last `grouped` days."""
    if kind not in ("max", "min"):
        raise ValueError("kind is max or min")
    inner, outer = ("min", F.max) if kind == "max" else ("max", F.min)
    if duration > 1:
        df = df.withColumn(value, W.rolling(inner, F.col(value), duration, keys, time))
    if per_day or grouped > 1:
        df = df.groupBy(*keys, F.to_date(time).alias(time)).agg(outer(value).alias(value))
    if grouped > 1:
        df = df.withColumn(value, W.rolling(inner, F.col(value), grouped, keys, time))
    block = (F.floor(F.year(time) / block_years) * block_years).cast("int")
    return df.groupBy(*keys, block.alias("block")).agg(outer(value).alias(value)).where(F.col(value).isNotNull())


def effective_sample_size(df: DataFrame, keys: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """n (1 - r) / (1 + r) with r the autocorrelation at lag 1, by series and year; values below 25 say that a block is too dependent."""
    lagged = df.withColumn("__prior", F.lag(value).over(W.series(keys, time)))
    got = lagged.groupBy(*keys, F.year(time).alias("year")).agg(F.count(value).alias("n"), F.corr(value, "__prior").alias("r"))
    return got.withColumn("ess", F.col("n") * F.try_divide(1 - F.col("r"), 1 + F.col("r")))


def gev_parameters(blocks: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n, shape, location, scale) of the GEV by L-moments, in the sign convention where a positive shape bounds the tail. Series of three or more values."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
    x = F.col(value)
    b = blocks.where(x.isNotNull()).withColumn("i", i).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("b0"), F.sum(F.col("i") * x).alias("s1"), F.sum(F.col("i") * (F.col("i") - 1) * x).alias("s2")).where("n >= 3")
    n = F.col("n")
    b = b.withColumn("b1", F.col("s1") / (n * (n - 1))).withColumn("b2", F.col("s2") / (n * (n - 1) * (n - 2)))
    b = b.withColumn("l2", 2 * F.col("b1") - F.col("b0")).withColumn("t3", F.try_divide(6 * F.col("b2") - 6 * F.col("b1") + F.col("b0"), F.col("l2")))
    b = b.withColumn("c", 2 / (3 + F.col("t3")) - math.log(2) / math.log(3)).withColumn("shape", 7.8590 * F.col("c") + 2.9554 * F.col("c") * F.col("c"))
    k = F.col("shape")
    b = b.withColumn("g", F.exp(log_gamma(1 + k))).withColumn("scale", F.col("l2") * k / ((1 - F.pow(F.lit(2.0), -k)) * F.col("g")))
    return b.withColumn("location", F.col("b0") - F.col("scale") * (1 - F.col("g")) / k).select(*keys, "n", "shape", "location", "scale")


def gev_return_values(parameters: DataFrame, keys: list[str], periods: list[int], kind: str = "max") -> DataFrame:
    """(keys, one_in_x, return_value)."""
    x = F.explode(F.array(*map(F.lit, periods))).alias("one_in_x")
    rows = parameters.select("*", x)
    q = 1 - 1 / F.col("one_in_x") if kind == "max" else 1 / F.col("one_in_x")
    k = F.col("shape")
    return rows.select(*keys, "one_in_x", (F.col("location") + F.col("scale") * (1 - F.pow(-F.log(q), k)) / k).alias("return_value"))


def gev_exceedance(parameters: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, probability of a block beyond threshold, its return period)."""
    k = F.col("shape")
    z = 1 - k * (F.lit(threshold) - F.col("location")) / F.col("scale")
    p = 1 - F.when(z > 0, F.exp(-F.pow(z, 1 / k))).when(k > 0, 1.0).otherwise(0.0)
    return parameters.select(*keys, p.alias("probability"), F.try_divide(F.lit(1.0), p).alias("return_period"))


def fit_series(blocks: DataFrame, keys: list[str], periods: list[int], kind: str = "gev", extremes: str = "max", bootstraps: int = 100, interval: tuple[float, float] = (2.5, 97.5), seed: int = 35, value: str = "value") -> DataFrame:
    """(keys, one_in_x, return_value, low, high, ks_d, ks_p) for any of the distributions, with a seeded bootstrap for each series."""
    if kind not in fits.FITS:
        raise ValueError(f"unknown distribution {kind}; there are {sorted(fits.FITS)}")
    fit = fits.FITS[kind]
    key_types = ", ".join(f"{k} {dict(blocks.dtypes)[k]}" for k in keys)

    def run(key, pdf):
        x = np.sort(pdf[value].dropna().to_numpy(float))
        columns = [*keys, "one_in_x", "return_value", "low", "high", "ks_d", "ks_p"]
        if len(x) < 4 or np.ptp(x) == 0:
            return pd.DataFrame(columns=columns)
        sign = 1 if extremes == "max" else -1
        p = fit(sign * x)
        d, pv = fits.ks_fit(kind, p, sign * x)
        draw = np.random.default_rng([seed, *[abs(hash_of(k)) for k in key]])
        boots = []
        for _ in range(bootstraps):
            y = sign * draw.choice(x, len(x))
            if np.ptp(y) > 0 and len(np.unique(y)) > 3:
                boots.append(fit(y))
        rows = []
        for t in periods:
            got = sorted(sign * fits.quantile(kind, b, 1 - 1 / t) for b in boots)
            low, high = (np.percentile(got, interval) if got else (np.nan, np.nan))
            rows.append((*key, t, sign * fits.quantile(kind, p, 1 - 1 / t), low, high, d, pv))
        return pd.DataFrame(rows, columns=columns)

    return blocks.select(*keys, value).groupBy(*keys).applyInPandas(run, f"{key_types}, one_in_x int, return_value double, low double, high double, ks_d double, ks_p double")


def hash_of(key) -> int:
    """A number for a key that is the same in every process."""
    import zlib

    return zlib.crc32(str(key).encode())


def ks_between(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value", level: float | None = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance for each key, all in window functions; rows with p below level only, or all if it is None.

    The p-value is the asymptotic series."""
    rows = a.select(*keys, F.col(value).alias("x"), F.lit(1).alias("s")).unionByName(b.select(*keys, F.col(value).alias("x"), F.lit(0).alias("s"))).where("x is not null")
    steps = rows.groupBy(*keys, "x").agg(F.sum("s").alias("na"), F.sum(1 - F.col("s")).alias("nb"))
    run = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    gap = F.abs(F.try_divide(F.sum("na").over(run), F.sum("na").over(whole)) - F.try_divide(F.sum("nb").over(run), F.sum("nb").over(whole)))
    d = steps.select(*keys, gap.alias("gap"), "na", "nb").groupBy(*keys).agg(F.max("gap").alias("d"), F.sum("na").alias("n_a"), F.sum("nb").alias("n_b")).where("n_a > 0 and n_b > 0")
    n = F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    t = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * F.col("d")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * t * t))
    out = d.withColumn("p", F.when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * terms))))
    return out if level is None else out.where(F.col("p") < level)
