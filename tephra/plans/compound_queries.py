"""Queries for compound events on grids with cells without values, and for column and catalog operators that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import events, geo, subset
from ..sources import catalog, scan
from .base import DAILY, GRID, query
from .series_queries import r
from .subset_queries import as_catalog

#: A grid of five cells a day; cell 4 is sea, without values.
SEA = """sea AS (SELECT l_returnflag AS sim, l_suppkey % 5 AS cell, CAST(l_shipdate AS DATE) AS time, CASE WHEN l_suppkey % 5 <> 4 THEN max(l_extendedprice) END AS tmax,
 CASE WHEN l_suppkey % 5 <> 4 THEN min(l_extendedprice) END AS tmin, CASE WHEN l_suppkey % 5 <> 4 THEN sum(l_quantity) END AS rain, round(avg(l_discount), 7) AS wind FROM lineitem GROUP BY 1, 2, 3)"""


def sea(spark, d):
    li = scan.table(spark, d, "lineitem")
    cell = F.col("l_suppkey") % 5
    got = li.groupBy(F.col("l_returnflag").alias("sim"), cell.alias("cell"), F.to_date("l_shipdate").alias("time"))
    got = got.agg(F.max("l_extendedprice").alias("tmax"), F.min("l_extendedprice").alias("tmin"), F.sum("l_quantity").alias("rain"), F.round(F.avg("l_discount"), 7).alias("wind"))
    return got.withColumns({c: subset.mask(F.col(c), F.col("cell") != 4) for c in ("tmax", "tmin", "rain")})


CELL = "OVER (PARTITION BY sim, cell ORDER BY time ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"


@query("J13_compound_count", f"WITH {SEA}, f AS (SELECT *, CASE WHEN count(rain) {CELL} >= 2 THEN sum(rain) {CELL} END > 150 AS wet, max(CASE WHEN wind > 0.06 THEN 1 ELSE 0 END) {CELL} = 1 AS windy FROM sea) SELECT sim, time, count(*) FILTER (WHERE wet AND windy) AS compound_count, count(*) FILTER (WHERE rain IS NOT NULL AND wind IS NOT NULL) AS cells FROM f GROUP BY 1, 2")
def j13_count(spark, d):
    return events.compound_count(sea(spark, d), ["sim", "cell"], ["sim", "time"], 150, 0.06, 2)


SITE = f"""{SEA}, site AS (SELECT sim, time, avg(wind) AS w FROM sea WHERE cell IN (0, 1) GROUP BY 1, 2), j AS (SELECT s.*, w < 0.05 AS calm FROM sea s LEFT JOIN site USING (sim, time)),
day AS (SELECT sim, time, count(*) FILTER (WHERE tmax IS NOT NULL AND tmin IS NOT NULL) AS cells, count(*) FILTER (WHERE tmin IS NOT NULL AND tmax > 50000) AS hot, count(*) FILTER (WHERE tmax IS NOT NULL AND tmin > 20000) AS warm,
 bool_or(coalesce(calm, false)) AS calm, count(*) FILTER (WHERE tmax > 50000 AND tmin > 20000 AND calm) AS compound FROM j GROUP BY 1, 2)"""


def site_days(spark, d):
    df = sea(spark, d)
    return events.hot_and_calm_site(df.drop("wind"), df.where("cell in (0, 1)").select("sim", "time", "wind"), ["sim"], 50000, 20000, 0.05)


@query("J14_site_wind_days", f"WITH {SITE} SELECT * FROM day")
def j14_days(spark, d):
    return site_days(spark, d)


@query("J14_site_wind_rates", f"WITH {SITE} SELECT sim, round(sum(hot) / nullif(max(cells), 0) / 7.0, 6) AS hot_rate, round(sum(warm) / nullif(max(cells), 0) / 7.0, 6) AS warm_rate, round(count(*) FILTER (WHERE calm) / 7.0, 6) AS calm_rate, round(sum(compound) / nullif(max(cells), 0) / 7.0, 6) AS compound_rate FROM day GROUP BY 1")
def j14_rates(spark, d):
    got = events.cell_rates(site_days(spark, d), ["sim"], 7.0)
    return got.select("sim", *[r(c).alias(c) for c in ("hot_rate", "warm_rate", "calm_rate", "compound_rate")])


STRESS = f"""{SEA}, f AS (SELECT *, sum(coalesce(tmax > 40000, false)::INT) {CELL} >= 2 AS hot, sum(coalesce(tmin > 15000, false)::INT) {CELL} >= 2 AS warm FROM sea WHERE cell <> 3),
s AS (SELECT sim, time, count(*) FILTER (WHERE hot AND tmax IS NOT NULL) / nullif(count(tmax), 0) >= 0.5 AS hot, count(*) FILTER (WHERE warm AND tmin IS NOT NULL) / nullif(count(tmin), 0) >= 0.5 AS warm FROM f GROUP BY 1, 2),
hit AS (SELECT sim, time, count(*) FILTER (WHERE tmax > 45000) / nullif(count(tmax), 0) >= 0.5 AS hit FROM sea GROUP BY 1, 2), day AS (SELECT sim, time FROM s JOIN hit USING (sim, time) WHERE hot AND warm AND hit)"""


@query("J15_stress_rate_of_masked_cells", f"WITH {STRESS} SELECT sim, round(count(*) / 7.0, 6) AS rate FROM day GROUP BY 1")
def j15_rate(spark, d):
    df = sea(spark, d)
    state = events.spatial_condition(df, ["sim", "time"], F.col("tmax") > 45000, 0.5, "tmax")
    land = scan.literal(spark, [(0,), (1,), (2,), (4,)], "cell long")
    days = events.stress_events(df, state, 40000, 15000, days=2, mask=land)
    return events.yearly_rate(days, ["sim"], 7.0).select("sim", r("rate").alias("rate"))


@query("J44_outlines_of_every_cell", f"""WITH {GRID}, c AS (SELECT DISTINCT cell, lat, lon FROM grid), p AS (SELECT DISTINCT lat, lon FROM c),
o AS (SELECT lat, lon, lon - coalesce(lon - lag(lon) OVER a, lead(lon) OVER a - lon) / 2 AS west, lon + coalesce(lead(lon) OVER a - lon, lon - lag(lon) OVER a) / 2 AS east, lat - coalesce(lat - lag(lat) OVER b, lead(lat) OVER b - lat) / 2 AS south, lat + coalesce(lead(lat) OVER b - lat, lat - lag(lat) OVER b) / 2 AS north FROM p WINDOW a AS (PARTITION BY lat ORDER BY lon), b AS (PARTITION BY lon ORDER BY lat))
SELECT cell, west, east, south, north FROM c JOIN o USING (lat, lon)""")
def j44_all(spark, d):
    c = scan.grid(spark, d).select("cell", "lat", "lon").distinct()
    return geo.cell_outlines(c, "lon", "lat").select("cell", "west", "east", "south", "north")


@query("B11_conditional_replace", f"WITH {DAILY} SELECT sim, time, CASE WHEN wind > 0.05 THEN -1.0 ELSE wind END AS wind FROM daily")
def b11(spark, d):
    return scan.daily(spark, d).select("sim", "time", F.when(F.col("wind") > 0.05, F.lit(-1.0)).otherwise(F.col("wind")).alias("wind"))


@query("B20_rename_assign_drop", f"WITH {DAILY} SELECT sim AS simulation, time AS day, round(tmax - tmin, 6) AS span, 'C' AS units FROM daily")
def b20(spark, d):
    got = scan.daily(spark, d).withColumnsRenamed({"sim": "simulation", "time": "day"}).withColumns({"span": r(F.col("tmax") - F.col("tmin")), "units": F.lit("C")})
    return got.drop("value", "rain", "wind", "tmax", "tmin")


@query("B21_insert_at_position", f"WITH {DAILY} SELECT sim, 'station' AS kind, time, value FROM daily")
def b21(spark, d):
    return subset.insert_at(scan.daily(spark, d).select("sim", "time", "value"), 1, "kind", F.lit("station"))


@query("B25_bias_adjusted_models", "SELECT o_orderstatus AS scenario, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%' GROUP BY 1")
def b25(spark, d):
    base = as_catalog(spark, d).get().withColumn("bias_adjusted", F.substring("gcm", 1, 1).isin("1", "3"))
    return catalog.from_frame(base).processes({"bias_adjusted": True}).get().groupBy("scenario").agg(F.count("*").alias("n"))


@query("B33_empty_of_the_same_columns", f"WITH {DAILY} SELECT sim, time, value FROM daily WHERE false")
def b33(spark, d):
    df = scan.daily(spark, d).select("sim", "time", "value")
    return spark.createDataFrame([], df.schema)


@query("D02_metric_step", "SELECT o_orderpriority AS gcm, round(max(o_totalprice), 2) AS max, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def d02(spark, d):
    got = as_catalog(spark, d).scenario("O").processes({"metric_calc": {"keys": ["gcm"], "metric": ["max", "mean"]}}).get()
    return got.select("gcm", r("max", 2).alias("max"), r("mean", 4).alias("mean"))


@query("I06_map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'historical' WHEN 'O' THEN 'ssp370' ELSE 'unknown' END AS scenario FROM orders")
def i06(spark, d):
    return scan.table(spark, d, "orders").select("o_orderkey", N.looked_up(F.col("o_orderstatus"), {"F": "historical", "O": "ssp370"}, "unknown").alias("scenario"))
