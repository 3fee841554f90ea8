"""Climate indices: degree days and hours, effective temperature, standardised and drought indices, pressure gradients."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fits import gamma_fit, gamma_p
from ..functions.weather import geostrophic
from .windows import series


def degree_days(tmax: Column, tmin: Column, heating: float, cooling: float) -> tuple[Column, Column]:
    """(HDD, CDD) of the mean of the day's extremes."""
    mean = (tmax + tmin) / 2
    held = mean.isNotNull()
    return F.when(held, F.greatest(heating - mean, F.lit(0.0))), F.when(held, F.greatest(mean - cooling, F.lit(0.0)))


def degree_hours(df: DataFrame, keys: list[str], heating: float, cooling: float, time: str = "time", value: str = "value") -> DataFrame:
    """Hours of each day below the heating and above the cooling threshold (counts of hours)."""
    return df.groupBy(*keys, F.to_date(time).alias("day")).agg(F.count_if(F.col(value) < heating).alias("hdh"), F.count_if(F.col(value) > cooling).alias("cdh"))


def effective_temperature(df: DataFrame, keys: list[str], time: str = "time", tmax: str = "tmax", tmin: str = "tmin", out: str = "teff") -> DataFrame:
    """0.7 x(t) + 0.003 n(t) x(t-1) + 0.002 n(t-1) x(t-2), NULL on the first two days."""
    w = series(keys, time)
    x, n = F.col(tmax), F.col(tmin)
    return df.withColumn(out, 0.7 * x + 0.003 * n * F.lag(x, 1).over(w) + 0.002 * F.lag(n, 1).over(w) * F.lag(x, 2).over(w))


def point_difference(df: DataFrame, keys: list[str], point: str, first, second, value: str = "value") -> DataFrame:
    """Difference and mean of two points' values at the same keys."""
    at = lambda p: F.max(F.when(F.col(point) == p, F.col(value)))
    got = df.where(F.col(point).isin(first, second)).groupBy(*keys).agg(at(first).alias("a"), at(second).alias("b"))
    return got.select(*keys, (F.col("a") - F.col("b")).alias("difference"), ((F.col("a") + F.col("b")) / 2).alias("mean"))


def geostrophic_wind(df: DataFrame, keys: list[str], spacing_m: float, height: str = "value", x: str = "x", y: str = "y", lat: str = "lat") -> DataFrame:
    """u and v at cells with both neighbours each way, by central differences of geopotential height. Each cell asks its row and its column once."""
    across = series([*keys, y], x)
    along = series([*keys, x], y)
    ok = (F.lead(x).over(across) - F.lag(x).over(across) == 2) & (F.lead(y).over(along) - F.lag(y).over(along) == 2)
    dx = (F.lead(height).over(across) - F.lag(height).over(across)) / (2 * spacing_m)
    dy = (F.lead(height).over(along) - F.lag(height).over(along)) / (2 * spacing_m)
    df = df.withColumn("__dx", dx).withColumn("__dy", dy).withColumn("__ok", ok).where("__ok")
    u, v = geostrophic(F.col("__dx"), F.col("__dy"), F.col(lat))
    return df.withColumn("u", u).withColumn("v", v).drop("__dx", "__dy", "__ok")


def standardised_index(df: DataFrame, keys: list[str], calibration: tuple[int, int], time: str = "time", value: str = "value", limit: float = 2.5) -> DataFrame:
    """Standard normal quantile of each month's value under a gamma distribution with a mass at zero, fitted to the calibration years of its
    calendar month; cut to +-limit. A series' month has one value a year, so a group is small."""
    groups = df.withColumn("__month", F.month(time)).withColumn("__year", F.year(time))

    def run(pdf):
        x = pdf[value].to_numpy(float)
        cal = x[(pdf["__year"] >= calibration[0]).to_numpy() & (pdf["__year"] <= calibration[1]).to_numpy() & ~np.isnan(x)]
        out = np.full(len(x), np.nan)
        wet = cal[cal > 0]
        if len(wet) >= 4 and np.ptp(wet) > 0:
            zero = 1 - len(wet) / len(cal)
            shape, scale = gamma_fit(wet)
            for i, v in enumerate(x):
                if v == v:
                    p = zero + (1 - zero) * (gamma_p(shape, v / scale) if v > 0 else 0.0)
                    out[i] = max(-limit, min(limit, NormalDist().inv_cdf(min(max(p, 1e-9), 1 - 1e-9))))
        return pdf.drop(columns=["__month", "__year"]).assign(index=pd.Series(out, index=pdf.index).astype(object).where(~np.isnan(out), None))

    return groups.groupBy(*keys, "__month").applyInPandas(run, df.withColumn("index", F.lit(0.0)).schema)


def palmer_spells(z: np.ndarray) -> np.ndarray:
    """Palmer's index of monthly moisture anomalies z: three sums x(t) = 0.897 x(t-1) + z(t) / 3 are kept, of a wet spell that may begin (0 or more), of a dry
    one (0 or less) and of the spell that holds. A beginning sum of 1 makes a spell hold. It ends once the excess over 0.15 of its months against it reaches what
    it takes to bring the sum to 0.5 in one month. Months in doubt wait for the outcome: if the spell goes on they take its sum, if it ends those of the spell
    that begins; without a spell, the sum that outlasts the other. Still in doubt at the end: the spell's sum, or the larger one."""
    out, doubt = np.zeros(len(z)), []
    wet = dry = held = against = 0.0

    def settle(which: int) -> None:
        """Back in time; where the sum taken has not begun, the other beginning one is taken from there."""
        while doubt:
            t, sums = doubt.pop()
            if which < 2 and sums[which] == 0:
                which = 1 - which
            out[t] = sums[which]

    for t, a in enumerate(z):
        wet, dry = max(0.0, 0.897 * wet + a / 3), min(0.0, 0.897 * dry + a / 3)
        ended = None
        if held:
            need = 2.691 * abs(held) - 1.5 + against
            against = max(0.0, against + 0.15 - np.sign(held) * a)
            if against > 0 and against >= need:
                ended, held, against = (1 if held > 0 else 0), 0.0, 0.0
            else:
                held = 0.897 * held + a / 3
                doubt.append((t, (wet, dry, held)))
                if against == 0:
                    settle(2)
                    wet = dry = 0.0
                continue
        doubt.append((t, (wet, dry, 0.0)))
        begun = 0 if wet >= 1 else 1 if dry <= -1 else None
        if begun is not None:
            settle(begun)
            held, wet, dry = (wet, dry)[begun], 0.0, 0.0
        elif ended is not None:
            settle(ended)
        elif wet == 0 or dry == 0:
            settle(0 if dry == 0 else 1)
    for t, sums in doubt:
        out[t] = sums[2] if held else max(sums[:2], key=abs)
    return out


def palmer(df: DataFrame, keys: list[str], capacity_in: float = 6.0, calibration: tuple[int, int] = (0, 9999), time: str = "time", precip: str = "precip", pet: str = "pet") -> DataFrame:
    """Palmer drought severity index of monthly precipitation and PET (inches): a two-layer water balance, its calibrated climatic departures, and the
    index of `palmer_spells`. It needs a series in order, so each series is one group; it has a row a month. Missing values count as 0."""

    def run(pdf):
        pdf = pdf.sort_values(time)
        p, e = pdf[precip].to_numpy(float), pdf[pet].to_numpy(float)
        month = pd.to_datetime(pdf[time]).dt.month.to_numpy() - 1
        year = pd.to_datetime(pdf[time]).dt.year.to_numpy()
        top, under, room = 1.0, capacity_in - 1.0, capacity_in - 1.0
        n = len(p)
        rec = np.zeros((n, 8))  # ET, PE, recharge, PR, runoff, PRO, loss, PL
        for t in range(n):
            pp, pe = (p[t] if p[t] == p[t] else 0.0), (e[t] if e[t] == e[t] else 0.0)
            pr, pro = capacity_in - top - under, top + under
            pls = min(pe, top)
            pl = min(pls + (pe - pls) * under / capacity_in, top + under)
            if pp >= pe:
                gain = pp - pe
                r1 = min(gain, 1.0 - top)
                r2 = min(gain - r1, room - under)
                top, under = top + r1, under + r2
                rec[t] = pe, pe, r1 + r2, pr, gain - r1 - r2, pro, 0.0, pl
            else:
                need = pe - pp
                l1 = min(top, need)
                l2 = min((need - l1) * under / capacity_in, under)
                top, under = top - l1, under - l2
                rec[t] = pp + l1 + l2, pe, 0.0, pr, 0.0, pro, l1 + l2, pl
        cal = (year >= calibration[0]) & (year <= calibration[1])
        ratio = lambda a, b, m: (a[cal & (month == m)].sum() / b[cal & (month == m)].sum()) if b[cal & (month == m)].sum() > 0 else 1.0
        co = np.array([[ratio(rec[:, j], rec[:, j + 1], m) for j in (0, 2, 4, 6)] for m in range(12)])
        c = co[month]
        expected = c[:, 0] * rec[:, 1] + c[:, 1] * rec[:, 3] + c[:, 2] * rec[:, 5] - c[:, 3] * rec[:, 7]
        d = np.nan_to_num(p) - expected
        big_d = np.array([np.abs(d[cal & (month == m)]).mean() if (cal & (month == m)).any() else 0.0 for m in range(12)])
        demand = np.array([(rec[cal & (month == m)][:, [1, 2, 4]].sum()) / max(1e-9, np.nansum(p[cal & (month == m)]) + rec[cal & (month == m)][:, 6].sum()) for m in range(12)])
        k1 = np.where(big_d > 0, 1.5 * np.log10(np.maximum(1e-9, (demand + 2.8) / np.maximum(big_d, 1e-9))) + 0.5, 0.0)
        total = (big_d * k1).sum()
        z = d * (17.67 * k1 / total if total > 0 else 0 * k1)[month]
        return pdf.assign(z_index=z, pdsi=palmer_spells(z))

    return df.groupBy(*keys).applyInPandas(run, df.withColumn("z_index", F.lit(0.0)).withColumn("pdsi", F.lit(0.0)).schema)


def inconsistent_dewpoint(df: DataFrame, sims: list[str], t: str = "t", td: str = "td", time: str = "time") -> DataFrame:
    """Percent of steps with a dew point above the temperature, by month: averaged over the simulations."""
    own = df.groupBy(*sims, F.month(time).alias("month")).agg((100.0 * F.count_if(F.col(td) > F.col(t)) / F.count("*")).alias("pct"))
    return own.groupBy("month").agg(F.avg("pct").alias("pct"))


def around_extremes(df: DataFrame, keys: list[str], hours: int = 72, time: str = "time", value: str = "value") -> DataFrame:
    """The steps within `hours` of each series' largest value."""
    peak = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(time, F.struct((-F.col(value)).alias("v"), F.col(time).alias("t"))).alias("peak"))
    gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("peak").cast("timestamp"))) / 3.6e9
    return df.join(peak, keys).withColumn("hours_from_peak", gap).where(F.abs("hours_from_peak") <= hours)

