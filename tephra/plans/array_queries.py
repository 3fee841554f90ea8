"""Queries for gridded files (written, then read back), the whole day window and the diagnostics of a bias correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import subset
from ..operators import windows as W
from ..sources import arrays, scan
from .base import DAILY, GRID, HOURLY, SCEN, query
from .series_queries import r
from .subset_queries import scratch


@query("A08_zarr_datasets_by_key", f"WITH {SCEN} SELECT scenario, gcm, time::TIMESTAMP AS time, value FROM scen WHERE scenario IN ('F', 'O')")
def a08(spark, d):
    """A store for each scenario, scanned as a dictionary of datasets."""
    df, root = scan.scenarios(spark, d), scratch(spark)
    found = {s: arrays.to_zarr(df.where(F.col("scenario") == s).drop("scenario"), f"{root}/{s}", ["gcm", "time"], chunks={"time": 400}) for s in ("F", "O")}
    sets = {s: arrays.zarr(spark, path, "value").where("value is not null") for s, path in found.items()}
    return subset.union_all(sets, "scenario")


@query("A09_zarr_scan_within", f"WITH {DAILY} SELECT sim, time::TIMESTAMP AS time, tmax FROM daily WHERE time BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def a09(spark, d):
    path = arrays.to_zarr(scan.daily(spark, d), scratch(spark), ["sim", "time"], "tmax", {"sim": 2, "time": 300})
    got = arrays.zarr(spark, path, "tmax", within={"time": ("1995-01-01", "1996-06-30")})
    return got.where("value is not null").withColumnRenamed("value", "tmax")


@query("A11_netcdf_scan", f"WITH {HOURLY} SELECT time, max(value) AS value FROM hourly GROUP BY 1")
def a11(spark, d):
    df = scan.hourly(spark, d).groupBy("time").agg(F.max("value").alias("value"))
    return arrays.netcdf(spark, arrays.netcdf_files(arrays.to_netcdf(df, scratch(spark), ["time"], steps=500)), "value")


@query("S06_netcdf_of_masked_cube", f"""WITH {GRID}, c AS (SELECT lat, lon, year, CASE WHEN lat < 35 THEN max(value) END AS v FROM grid GROUP BY 1, 2, 3)
SELECT y.year, a.lat, o.lon, c.v AS value FROM (SELECT DISTINCT year::DOUBLE AS year FROM grid) y CROSS JOIN (SELECT DISTINCT lat FROM grid) a CROSS JOIN (SELECT DISTINCT lon FROM grid) o LEFT JOIN c ON c.year = y.year AND c.lat = a.lat AND c.lon = o.lon""")
def s06(spark, d):
    cells = scan.grid(spark, d).groupBy("year", "lat", "lon").agg(F.max("value").alias("v"))
    cube = cells.select("year", "lat", "lon", subset.mask(F.col("v"), F.col("lat") < 35).alias("value"))
    return arrays.netcdf(spark, arrays.netcdf_files(arrays.to_netcdf(cube, scratch(spark), ["year", "lat", "lon"], steps=3)), "value")


@query("E17_day_window_of_45", f"WITH {HOURLY}, b AS (SELECT sim, CAST(dayofyear(time) AS INT) AS doy, value FROM hourly), x AS (SELECT sim, (doy - 1 + s + 365) % 365 + 1 AS doy, value FROM b, range(-45, 46) t(s) WHERE doy + s <= 365 + 45) SELECT sim, CAST(doy AS INT) AS doy, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM x GROUP BY 1, 2")
def e17_whole(spark, d):
    """The operator's own window: 45 days either side."""
    q = W.day_window_quantiles(scan.hourly(spark, d).withColumn("doy", F.dayofyear("time")), ["sim"], [0.25, 0.75])
    return q.select("sim", "doy", r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("q75"))


DIAGNOSED = f"{DAILY}, q AS (SELECT sim, time, tmax, tmax * 0.9 + 100 AS adjusted, value AS observed FROM daily)"
MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("tmax", "adjusted", "observed"))


def diagnosed(spark, d):
    df = scan.daily(spark, d)
    return df.select("sim", "time", "tmax", (F.col("tmax") * 0.9 + 100).alias("adjusted"), F.col("value").alias("observed"))


@query("J41_day_of_year_means", f"WITH {DIAGNOSED} SELECT sim, CAST(dayofyear(time) AS INT) AS doy, {MEANS} FROM q GROUP BY 1, 2")
def j41_days(spark, d):
    return means_by(diagnosed(spark, d), ["sim"], F.dayofyear("time").alias("doy"))


@query("J41_annual_means", f"WITH {DIAGNOSED} SELECT sim, CAST(year(time) AS INT) AS year, {MEANS} FROM q GROUP BY 1, 2")
def j41_years(spark, d):
    return means_by(diagnosed(spark, d), ["sim"], F.year("time").alias("year"))


def means_by(df, keys, part):
    return df.groupBy(*keys, part).agg(*[r(F.avg(c)).alias(c) for c in ("tmax", "adjusted", "observed")])
