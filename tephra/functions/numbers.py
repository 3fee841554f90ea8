"""Column helpers for values: missing data, guarded division, clamps, units, calendars and simulation names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factor and offset from a native unit to a target unit.
UNITS = {
    ("K", "degC"): (1.0, -273.15),
    ("K", "degF"): (1.8, -459.67),
    ("degC", "degF"): (1.8, 32.0),
    ("degC", "K"): (1.0, 273.15),
    ("degF", "degC"): (5.0 / 9.0, -160.0 / 9.0),
    ("m s-1", "mph"): (2.2369362920544, 0.0),
    ("m s-1", "knots"): (1.9438444924406, 0.0),
    ("kg m-2 s-1", "mm/d"): (86400.0, 0.0),
    ("kg m-2 s-1", "inches/d"): (86400.0 / 25.4, 0.0),
    ("mm", "inches"): (1.0 / 25.4, 0.0),
    ("mm/d", "inches/d"): (1.0 / 25.4, 0.0),
    ("Pa", "hPa"): (0.01, 0.0),
    ("hPa", "Pa"): (100.0, 0.0),
    ("%", "fraction"): (0.01, 0.0),
    ("fraction", "%"): (100.0, 0.0),
    ("kg kg-1", "g kg-1"): (1000.0, 0.0),
}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the source data; NULL does so here, so that comparisons and aggregates skip it."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def convert(value: Column, have: str, want: str) -> Column:
    if have == want:
        return value
    if (have, want) not in UNITS:
        raise ValueError(f"no conversion from {have} to {want}")
    factor, offset = UNITS[have, want]
    return value * F.lit(factor) + F.lit(offset)


def guarded(numerator: Column, denominator: Column, floor: float | None = None) -> Column:
    """Division whose denominator is raised to floor, or gives NULL at zero without one."""
    if floor is not None:
        return numerator / F.greatest(denominator, F.lit(floor))
    return F.try_divide(numerator, denominator)


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


COMPARE = {">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t, "<=": lambda v, t: v <= t}


def beyond(value: Column, threshold, direction: str = ">") -> Column:
    """Comparison in a chosen direction; missing values compare false."""
    if direction not in COMPARE:
        raise ValueError(f"direction must be one of {sorted(COMPARE)}")
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(COMPARE[direction](value, threshold), F.lit(False))


def season(time: Column) -> Column:
    m = F.month(time)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def water_year(time: Column) -> Column:
    return F.year(time) + (F.month(time) >= 10).cast("int")


def noleap_day(time: Column) -> Column:
    """Day of a 365-day year; NULL on February 29th."""
    leap = ((F.year(time) % 4 == 0) & ((F.year(time) % 100 != 0) | (F.year(time) % 400 == 0)))
    day = F.dayofyear(time)
    return F.when(~((F.month(time) == 2) & (F.dayofmonth(time) == 29)), day - F.when(leap & (F.month(time) > 2), 1).otherwise(0))


def hour_of_year(time: Column) -> Column:
    """0 to 8759 in a 365-day year; NULL on February 29th."""
    return (noleap_day(time) - 1) * 24 + F.hour(time)


def sim_part(sim: Column, i: int) -> Column:
    return F.try_element_at(F.split(sim, "_"), F.lit(i + 1))


def parse_sim(df: DataFrame, sim: str = "sim") -> DataFrame:
    """Adds activity, institution, gcm, scenario, table_id, grid_label and member to WRF_UCLA_<gcm>_<scenario>_<table>_<grid>_<member> names.

    Shorter names, <activity>_<institution>_<gcm>_<scenario>_<member>, have no table and grid."""
    s, n = F.col(sim), F.size(F.split(F.col(sim), "_"))
    names = ["activity", "institution", "gcm", "scenario"]
    df = df.withColumns({c: sim_part(s, i) for i, c in enumerate(names)})
    return df.withColumns({"table_id": F.when(n >= 7, sim_part(s, 4)), "grid_label": F.when(n >= 7, sim_part(s, 5)), "member": F.when(n >= 7, sim_part(s, 6)).when(n == 5, sim_part(s, 4))})


def looked_up(key: Column, values: dict, default=None) -> Column:
    """The value of a small fixed map at the key, or the default where it has none."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
