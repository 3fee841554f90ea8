"""Queries for the remaining operators of scans, subsets, joins, reshaping and composed analyses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import aggregates as A
from ..operators import basins, ensemble, events, extremes, geo, joins, profiles, subset, warming
from ..operators import windows as W
from ..sources import catalog, scan, sinks
from .base import DAILY, GRID, HOURLY, MONTHLY, SCEN, YEARLY, query
from .series_queries import BLOCKS, GEV, over, r
from .subset_queries import as_catalog, monthly, scratch, yearly


@query("A04_multi_valued_facet", "SELECT o_orderpriority AS gcm, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def a04(spark, d):
    return as_catalog(spark, d).scenario(["F", "O"]).get().groupBy("gcm").agg(F.count("*").alias("n"))


@query("A06_catalog_uniques", "SELECT p_brand, count(DISTINCT p_type) AS types FROM part GROUP BY 1")
def a06(spark, d):
    return scan.table(spark, d, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"))


@query("A13_boundaries_from_wkt", "SELECT * FROM (VALUES (1, 0::INT, 4::BIGINT, 0.0::DOUBLE, 2.0::DOUBLE), (2, 0, 4, 5.0, 6.0), (2, 1, 3, 7.0, 9.5)) t(region_id, part, points, west, east)")
def a13(spark, d):
    w = scan.literal(spark, [(1, "POLYGON ((0 0, 2 0, 2 1, 0 1))"), (2, "MULTIPOLYGON (((5 5, 6 5, 6 6, 5 6)), ((7 7, 9.5 7, 8 8)))")], "region_id int, wkt string")
    e = geo.edges_of(geo.rings_from_wkt(w))
    return e.groupBy("region_id", "part").agg(F.count("*").alias("points"), F.min("x1").alias("west"), F.max("x1").alias("east"))


@query("A16_flip_mask", f"WITH {GRID} SELECT DISTINCT cell, 9 - (cell % 10) AS x FROM grid")
def a16(spark, d):
    return geo.flip_columns(scan.grid(spark, d).select("cell", (F.col("cell") % 10).alias("x")).distinct(), 10)


@query("A19_functional_retrieve", "SELECT o_orderstatus AS scenario, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def a19(spark, d):
    return catalog.get_data(as_catalog(spark, d), "t2", table_id="day").groupBy("scenario").agg(F.count("*").alias("n"))


@query("A20_history_and_warm", "SELECT o_orderpriority AS gcm, count(*) FILTER (WHERE o_orderstatus = 'F') AS hist, count(*) FILTER (WHERE o_orderstatus = 'O') AS warm FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END) = 2")
def a20(spark, d):
    h, w = catalog.history_and_warm(as_catalog(spark, d), ["1-URGENT", "5-LOW"], "O", "F")
    return h.unionByName(w).groupBy("gcm").agg(F.count_if(F.col("scenario") == "F").alias("hist"), F.count_if(F.col("scenario") == "O").alias("warm"))


@query("S05_bundle", "SELECT n_name, count(*) AS n FROM (SELECT n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 2) GROUP BY 1")
def s05(spark, d):
    n = scan.table(spark, d, "nation").withColumn("time", F.lit("1950"))
    path = sinks.bundle({"region 1": n.where("n_regionkey = 1"), "region 2": n.where("n_regionkey = 2")}, scratch(spark), "flow")
    return spark.read.option("header", True).csv(f"{path}/flow/clean").groupBy("n_name").agg(F.count("*").alias("n"))


@query("S07_weather_file", "SELECT CAST(26 AS BIGINT) AS lines")
def s07(spark, d):
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour_of_year"), (F.col("id") * 1.5).alias("t"))
    return spark.read.text(sinks.weather_file(hours, scratch(spark), "here", 34.0, -118.0, ["t"])).agg(F.count("*").alias("lines"))


@query("B08_clip_point", f"WITH {GRID}, c AS (SELECT DISTINCT cell, lat, lon FROM grid), b AS (SELECT arg_min(cell, (round(power(lat - 33.3, 2) + power(lon + 118.4, 2), 9), cell)) AS cell FROM c) SELECT year, round(avg(value), 5) AS value FROM grid WHERE cell = (SELECT cell FROM b) GROUP BY 1")
def b08(spark, d):
    point = scan.literal(spark, [(1, 33.3, -118.4)], "point int, lat double, lon double")
    df = catalog.from_frame(scan.grid(spark, d)).processes({"clip": {"points": point, "reach": 6.0}}).get()
    return df.groupBy("year").agg(r(F.avg("value"), 5).alias("value"))


@query("B09_clip_polygon", f"WITH {GRID} SELECT year, count(*) AS n FROM grid WHERE lat > 32.2 AND lat < 34.2 AND lon > -120.2 AND lon < -117.8 GROUP BY 1")
def b09(spark, d):
    polygons = geo.rings_from_wkt(scan.literal(spark, [(1, "POLYGON ((-120.2 32.2, -117.8 32.2, -117.8 34.2, -120.2 34.2))")], "region_id int, wkt string"))
    return catalog.from_frame(scan.grid(spark, d)).processes({"clip": {"polygons": polygons}}).get().groupBy("year").agg(F.count("*").alias("n"))


@query("B17_expression_filter", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey BETWEEN 3 AND 9 GROUP BY 1")
def b17(spark, d):
    return scan.table(spark, d, "customer").where("c_acctbal > 0 and c_nationkey between 3 and 9").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("B26_drop_incomplete_windows", f"WITH {YEARLY}, i AS (SELECT scenario, gcm FROM yearly GROUP BY 1, 2 HAVING min(value) < 140000) SELECT year, round(quantile_cont(value, 0.5), 6) AS value FROM yearly y WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.scenario = y.scenario AND i.gcm = y.gcm) GROUP BY 1")
def b26(spark, d):
    y = yearly(spark, d)
    bad = y.groupBy("scenario", "gcm").agg(F.min("value").alias("m")).where("m < 140000")
    return subset.complete_windows(y, bad, ["scenario", "gcm"]).groupBy("year").agg(r(F.percentile("value", F.lit(0.5))).alias("value"))


@query("B31_map_projection", f"WITH {GRID} SELECT DISTINCT cell, round(6378137.0::DOUBLE * radians(lon), 2) AS mx, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)), 2) AS my FROM grid")
def b31(spark, d):
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    return scan.grid(spark, d).select("cell", r(x, 2).alias("mx"), r(y, 2).alias("my")).distinct()


@query("B34_casts", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(p_size AS VARCHAR) AS label FROM part")
def b34(spark, d):
    return scan.table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("long").alias("whole"), F.col("p_size").cast("string").alias("label"))


@query("C03_broadcast_threshold", f"WITH {DAILY}, s AS (SELECT time, round(avg(value), 7) AS mean FROM daily GROUP BY 1) SELECT d.sim, count(*) FILTER (WHERE d.value > s.mean) AS above FROM daily d JOIN s ON d.time = s.time GROUP BY 1")
def c03(spark, d):
    df = scan.daily(spark, d)
    state = df.groupBy("time").agg(F.round(F.avg("value"), 7).alias("mean"))
    return joins.lookup(df, state, ["time"]).groupBy("sim").agg(F.count_if(F.col("value") > F.col("mean")).alias("above"))


@query("C13_lags", f"WITH {DAILY} SELECT sim, time, lag(value) OVER w AS one, lag(value, 2) OVER w AS two FROM daily WINDOW w AS (PARTITION BY sim ORDER BY time)")
def c13(spark, d):
    w = W.series(["sim"])
    return scan.daily(spark, d).select("sim", "time", F.lag("value", 1).over(w).alias("one"), F.lag("value", 2).over(w).alias("two"))


@query("D04_cells_per_day", "SELECT l_returnflag AS sim, CAST(l_shipdate AS DATE) AS time, count(*) FILTER (WHERE l_quantity > 30 AND l_discount > 0.05) AS cells FROM lineitem GROUP BY 1, 2")
def d04(spark, d):
    flag = (F.col("l_quantity") > 30) & (F.col("l_discount") > 0.05)
    return scan.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sim"), F.to_date("l_shipdate").alias("time")).agg(F.count_if(flag).alias("cells"))


@query("D19_multi_model_mean", f"WITH {YEARLY} SELECT scenario, year, round(avg(value), 5) AS value FROM yearly GROUP BY 1, 2")
def d19(spark, d):
    return A.reduce(yearly(spark, d), ["scenario", "year"], ["mean"]).select("scenario", "year", r("mean", 5).alias("value"))


@query("D22_annual_per_cell", f"WITH {GRID} SELECT sim, year, round(sum(value) / count(DISTINCT cell), 5) AS value FROM grid GROUP BY 1, 2")
def d22(spark, d):
    return scan.grid(spark, d).groupBy("sim", "year").agg(r(F.sum("value") / F.countDistinct("cell"), 5).alias("value"))


@query("D31_variance_crossover", f"WITH {YEARLY}, b AS (SELECT year, var_samp(m) AS s, avg(v) AS m FROM (SELECT scenario, year, avg(value) AS m, var_pop(value) AS v FROM yearly GROUP BY 1, 2) GROUP BY 1) SELECT min(CASE WHEN s > m THEN year END) AS crossover FROM b")
def d31(spark, d):
    y = yearly(spark, d).withColumnRenamed("gcm", "sim")
    return ensemble.crossover(ensemble.scenario_against_model(y, smooth=1, min_periods=1))


@query("E04_trailing_mean", f"WITH {DAILY} SELECT sim, time, CASE WHEN count(value) {over('364 PRECEDING', 'CURRENT ROW')} >= 365 THEN round(avg(value) {over('364 PRECEDING', 'CURRENT ROW')}, 5) END AS value FROM daily")
def e04(spark, d):
    return scan.daily(spark, d).select("sim", "time", r(W.rolling("mean", F.col("value"), 365, ["sim"]), 5).alias("value"))


@query("E21_first_and_last", f"WITH {DAILY} SELECT sim, arg_min(value, time) AS first, arg_max(value, time) AS last FROM daily GROUP BY 1")
def e21(spark, d):
    return scan.daily(spark, d).groupBy("sim").agg(F.min_by("value", "time").alias("first"), F.max_by("value", "time").alias("last"))


@query("F01_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def f01(spark, d):
    return scan.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("F04_first_candidate_cell", f"WITH {GRID}, c AS (SELECT DISTINCT cell, lat, lon FROM grid WHERE value > 45000) SELECT arg_min(cell, (lat, lon, cell)) AS cell FROM c")
def f04(spark, d):
    return scan.grid(spark, d).where("value > 45000").agg(F.min_by("cell", F.struct("lat", "lon", "cell")).alias("cell"))


@query("G02_concat_dimension", f"WITH {MONTHLY} SELECT 'early' AS period, count(*) AS n FROM monthly WHERE year(time) <= 1997 UNION ALL SELECT 'late', count(*) FROM monthly WHERE year(time) >= 1999")
def g02(spark, d):
    m = monthly(spark, d)
    return subset.union_all({"early": m.where(F.year("time") <= 1997), "late": m.where(F.year("time") >= 1999)}, "period").groupBy("period").agg(F.count("*").alias("n"))


@query("H03_wide_by_year", f"WITH {YEARLY} SELECT scenario, gcm, max(CASE WHEN year = 1996 THEN value END) AS y1996, max(CASE WHEN year = 1999 THEN value END) AS y1999 FROM yearly GROUP BY 1, 2")
def h03(spark, d):
    p = yearly(spark, d).groupBy("scenario", "gcm").pivot("year", [1996, 1999]).agg(F.first("value"))
    return p.withColumnsRenamed({"1996": "y1996", "1999": "y1999"})


@query("H06_days_of_hours", f"WITH {HOURLY} SELECT sim, CAST(floor(((dayofyear(time) - 1) * 24 + hour(time)) / 24) AS BIGINT) AS day, count(*) AS n FROM hourly GROUP BY 1, 2")
def h06(spark, d):
    return scan.hourly(spark, d).groupBy("sim", F.floor(N.hour_of_year(F.col("time")) / 24).alias("day")).agg(F.count("*").alias("n"))


@query("H10_polygon_bounds", "SELECT * FROM (VALUES (1, 0.0::DOUBLE, 9.0::DOUBLE, 0.0::DOUBLE, 8.0::DOUBLE)) t(region_id, west, east, south, north)")
def h10(spark, d):
    w = scan.literal(spark, [(1, "MULTIPOLYGON (((0 0, 2 0, 2 1, 0 1)), ((7 7, 9 7, 8 8)))")], "region_id int, wkt string")
    return geo.bounds(geo.rings_from_wkt(w)).select("region_id", "west", "east", "south", "north")


@query("I05_array_functions", "SELECT CAST(s AS INT) AS n, CAST(s * (s + 1) / 2 AS BIGINT) AS total FROM range(1, 11) t(s)")
def i05(spark, d):
    n = F.col("id").cast("int")
    return spark.range(1, 11).select(n.alias("n"), F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("J06_one_in_x_step", f"WITH {GEV} SELECT sim, CAST(20 AS INT) AS one_in_x, round(location + scale * (1 - power(-ln(1 - 1.0::DOUBLE / 20), shape)) / shape, 3) AS return_value FROM gev")
def j06(spark, d):
    blocks = extremes.block_extremes(scan.daily(spark, d), ["sim"])
    return extremes.gev_return_values(extremes.gev_parameters(blocks, ["sim"]), ["sim"], [20]).withColumn("return_value", r("return_value", 3))


@query("J07_event_in_profile", f"WITH {HOURLY}, p AS (SELECT (dayofyear(time) - 1) * 24 + hour(time) AS h, quantile_cont(value, 0.5) AS v FROM hourly GROUP BY 1) SELECT CAST(h AS INT) AS hour_of_year, round(greatest(v, v + greatest(0, 1 - abs(h - 300) / 48.0::DOUBLE) * (500 - v)), 6) AS value FROM p")
def j07(spark, d):
    h = scan.hourly(spark, d).withColumn("hour_of_year", N.hour_of_year(F.col("time"))).withColumn("place", F.lit("all"))
    event = scan.literal(spark, [("all", 500.0)], "place string, return_value double")
    got = profiles.insert_event(profiles.standard_year(h, ["place"]), event, ["place"], at=300, half=48)
    return got.select("hour_of_year", r("value").alias("value"))


@query("J11_median_year", f"WITH {HOURLY} SELECT sim, CAST(hour(time) AS INT) AS hour, round(quantile_cont(value, 0.5), 6) AS value FROM hourly GROUP BY 1, 2")
def j11(spark, d):
    return scan.hourly(spark, d).groupBy("sim", F.hour("time").alias("hour")).agg(r(F.percentile("value", F.lit(0.5))).alias("value"))


CELLS = """cells AS (SELECT l_returnflag AS sim, l_suppkey % 5 AS cell, CAST(l_shipdate AS DATE) AS time, max(l_extendedprice) AS tmax, min(l_extendedprice) AS tmin FROM lineitem GROUP BY 1, 2, 3)"""


@query("J15_stress_events", f"""WITH {CELLS}, f AS (SELECT *, sum((tmax > 40000)::INT) OVER w >= 2 AS hot, sum((tmin > 15000)::INT) OVER w >= 2 AS warm FROM cells WINDOW w AS (PARTITION BY sim, cell ORDER BY time ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
s AS (SELECT sim, time, avg(hot::INT) >= 0.5 AS hot, avg(warm::INT) >= 0.5 AS warm, avg((tmax > 45000)::INT) >= 0.5 AS hit FROM f GROUP BY 1, 2) SELECT sim, time FROM s WHERE hot AND warm AND hit""")
def j15(spark, d):
    li = scan.table(spark, d, "lineitem")
    cells = li.groupBy(F.col("l_returnflag").alias("sim"), (F.col("l_suppkey") % 5).alias("cell"), F.to_date("l_shipdate").alias("time")).agg(F.max("l_extendedprice").alias("tmax"), F.min("l_extendedprice").alias("tmin"))
    state = events.spatial_condition(cells, ["sim", "time"], F.col("tmax") > 45000, 0.5, "tmax")
    return events.stress_events(cells, state, 40000, 15000, days=2)


@query("J23_classify_simulations", f"WITH {YEARLY}, m AS (SELECT scenario || gcm AS sim, avg(value) AS metric FROM yearly GROUP BY 1) SELECT sim, label FROM (SELECT sim, 'min' AS label, row_number() OVER (ORDER BY metric, sim) AS k FROM m UNION ALL SELECT sim, 'max', row_number() OVER (ORDER BY metric DESC, sim DESC) FROM m) WHERE k = 1")
def j23(spark, d):
    m = yearly(spark, d).groupBy(F.concat("scenario", "gcm").alias("sim")).agg(F.avg("value").alias("metric"))
    return subset.pick_simulations(m, "sim", "metric").where(F.col("label").isin("min", "max")).select("sim", "label")


@query("J36_slice_of_joined_series", f"WITH {MONTHLY}, u AS (SELECT scenario, gcm, time, value, 'baseline' AS segment FROM monthly WHERE year(time) <= 1997 UNION ALL SELECT scenario, gcm, time, value, 'future' FROM monthly WHERE year(time) >= 1999), q AS (SELECT *, row_number() OVER (PARTITION BY scenario, gcm ORDER BY segment, time) - 1 AS step FROM u) SELECT scenario, gcm, CAST(step - 48 AS INT) AS time_delta, value FROM q WHERE step BETWEEN 36 AND 59")
def j36(spark, d):
    m = monthly(spark, d)
    both = subset.joined_calendar(m.where(F.year("time") <= 1997), m.where(F.year("time") >= 1999), ["scenario", "gcm"])
    return both.where("step between 36 and 59").select("scenario", "gcm", (F.col("step") - 48).alias("time_delta"), "value")


@query("J40_model_and_station", f"WITH {MONTHLY}, o AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, round(avg(l_extendedprice), 7) AS value FROM lineitem GROUP BY 1), a AS (SELECT 'station' AS kind, time, value FROM o UNION ALL SELECT 'model', time, round(avg(value), 7) FROM monthly WHERE scenario = 'F' GROUP BY time), s AS (SELECT kind, time, CASE WHEN count(*) OVER w >= 12 THEN avg(value) OVER w END AS v FROM a WHERE year(time) BETWEEN 1995 AND 2000 WINDOW w AS (PARTITION BY kind ORDER BY time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT kind, time, round(v, 5) AS smooth FROM s WHERE v > 0.1")
def j40(spark, d):
    station = scan.table(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("time")).agg(F.round(F.avg("l_extendedprice"), 7).alias("value"))
    model = monthly(spark, d).where("scenario = 'F'").groupBy("time").agg(F.round(F.avg("value"), 7).alias("value"))
    both = subset.time_slice(subset.union_all({"station": station, "model": model}, "kind"), 1995, 2000)
    return both.select("kind", "time", r(W.rolling("mean", F.col("value"), 12, ["kind"]), 5).alias("smooth")).where("smooth > 0.1")


@query("J43_hydrology_bundle", f"WITH {DAILY} SELECT sim, CAST(date_trunc('month', time) AS DATE) AS time, round(sum(rain), 2) AS pr, round(avg(tmax), 5) AS tasmax FROM daily GROUP BY 1, 2")
def j43(spark, d):
    df = scan.daily(spark, d)
    pr = A.resample(df.select("sim", "time", F.col("rain").alias("value")), ["sim"], "month", "sum")
    tx = A.resample(df.select("sim", "time", F.col("tmax").alias("value")), ["sim"], "month", "mean")
    path = sinks.export(joins.merge({"pr": pr, "tasmax": tx}, ["sim", "time"]), scratch(spark), "parquet", "data", ["sim"])
    return scan.parquet(spark, path).select("sim", "time", r("pr", 2).alias("pr"), r("tasmax", 5).alias("tasmax"))
