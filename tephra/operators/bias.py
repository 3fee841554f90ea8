"""Quantile delta mapping of model series to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import noleap_day
from .windows import day_window_quantiles


def quantile_delta_mapping(obs: DataFrame, model: DataFrame, keys: list[str], train: tuple[int, int], quantiles: int = 20, half_window: int = 45, additive: bool = True, time: str = "time", value: str = "value") -> DataFrame:
    """Adjusts every model value by the difference (or ratio) that observations and the model's training years have at the value's own quantile.

    Quantiles are of all values within half_window days of the day of the year. The value's rank is its place among its own series' quantiles of that day.
    Adds `adjusted`. Quantile tables have a row for each series and day; the interpolation is an expression over their arrays."""
    probabilities = [(i + 0.5) / quantiles for i in range(quantiles)]
    day = noleap_day(F.col(time))
    o = day_window_quantiles(obs.withColumn("doy", day).where("doy is not null"), keys, probabilities, half_window, "doy", value).withColumnRenamed("q", "q_obs")
    m = model.withColumn("doy", F.coalesce(day, F.lit(59)))
    own = m.where(day.isNotNull())
    h = day_window_quantiles(own.where(F.year(time).between(*train)), keys, probabilities, half_window, "doy", value).withColumnRenamed("q", "q_train")
    a = day_window_quantiles(own, keys, probabilities, half_window, "doy", value).withColumnRenamed("q", "q_all")
    joined = m.join(o, [*keys, "doy"], "left").join(h, [*keys, "doy"], "left").join(a, [*keys, "doy"], "left")
    at = F.array(*map(F.lit, probabilities))
    v = F.col(value)
    ranked = joined.withColumn("__rank", interpolated(v, F.col("q_all"), at))
    wanted, had = interpolated(F.col("__rank"), at, F.col("q_obs")), interpolated(F.col("__rank"), at, F.col("q_train"))
    adjusted = v + wanted - had if additive else F.try_divide(v * wanted, had)
    return ranked.withColumn("adjusted", F.when(~F.isnan(v.cast("double")), adjusted).cast("double")).drop("__rank", "q_obs", "q_train", "q_all", "doy")


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear interpolation of x between the points (xs, ys), xs ascending arrays; flat beyond their ends; NULL for a NULL."""

    def between(k):  # the number of points up to x, found once
        x0, x1, y0, y1 = (F.try_element_at(c, i) for c in (xs, ys) for i in (k, k + 1))
        return F.when(k == 0, F.try_element_at(ys, F.lit(1))).when(k >= F.size(xs), F.try_element_at(ys, F.size(ys))).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))

    found = F.transform(F.array(F.size(F.filter(xs, lambda e: e <= x))), between)[0]
    return F.when(x.isNotNull() & xs.isNotNull() & ys.isNotNull(), found)
