"""Queries for scans, catalog, subsetting, units, joins, sets, sorting, reshaping and scalar functions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import derived  # noqa: F401  registers the derived variables
from ..functions import numbers as N
from ..functions import weather as X
from ..operators import aggregates as A
from ..operators import geo, joins, subset, warming
from ..operators import windows as W
from ..sources import catalog, scan, sinks
from .base import DAILY, GRID, HOURLY, MONTHLY, SCEN, YEARLY, query


def yearly(spark, d):
    s = scan.scenarios(spark, d)
    return s.groupBy("scenario", "gcm", F.year("time").alias("year")).agg(F.round(F.avg("value"), 7).alias("value"))


def monthly(spark, d):
    s = scan.scenarios(spark, d)
    return s.groupBy("scenario", "gcm", F.date_trunc("month", "time").cast("date").alias("time")).agg(F.round(F.avg("value"), 7).alias("value"))


def scratch(spark) -> str:
    """A new path in the folder that all machines share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tephra-")
    return f"{root}/tephra-{uuid.uuid4().hex}"


def as_catalog(spark, d):
    """orders as a long climate table with facets."""
    o = scan.table(spark, d, "orders")
    return catalog.from_frame(
        o.select(
            F.lit("WRF").alias("activity"), F.lit("UCLA").alias("institution"), F.col("o_orderpriority").alias("gcm"), F.col("o_orderstatus").alias("scenario"), F.lit("day").alias("table_id"),
            F.lit("d01").alias("grid_label"), F.concat(F.lit("r"), F.col("o_custkey") % 4).alias("member"), F.when(F.col("o_orderkey") % 2 == 0, "t2").otherwise("rh").alias("variable"),
            F.lit("K").alias("units"), F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"),
        )
    )


@query("A01_catalog_query", "SELECT o_orderpriority AS gcm, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def a01(spark, d):
    df = as_catalog(spark, d).scenario("F").variable("t2").processes({"time_slice": ("1996", "1997")}).get()
    return df.groupBy("gcm").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("A02_query_from_dict", "SELECT o_orderstatus AS scenario, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 2 = 1 GROUP BY 1")
def a02(spark, d):
    return catalog.from_dict(as_catalog(spark, d), {"scenario": ["F", "O"], "variable": "rh"}).get().groupBy("scenario").agg(F.count("*").alias("n"))


@query("A05_catalog_options", "SELECT DISTINCT o_orderpriority AS gcm FROM orders WHERE o_orderstatus = 'P'")
def a05(spark, d):
    return as_catalog(spark, d).scenario("P").gcm("unused").options("gcm")


@query("A07_models_with_all", "SELECT o_custkey AS cust FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3")
def a07(spark, d):
    return subset.relational_division(scan.table(spark, d, "orders").withColumnRenamed("o_custkey", "cust"), "cust", "o_orderstatus", ["F", "O", "P"])


@query("A10_multi_path_scan", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey FROM nation)")
def a10(spark, d):
    both = scan.parquet(spark, f"{d}/nation.parquet").unionByName(scan.parquet(spark, f"{d}/nation.parquet"))
    return both.agg(F.count("*").alias("n"), F.sum("n_nationkey").cast("long").alias("total"))


@query("A12_csv_round_trip", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def a12(spark, d):
    path = scratch(spark)
    sinks.csv_names(scan.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").withColumnRenamed("c_acctbal", "c acctbal")).write.option("header", True).csv(path)
    return scan.csv(spark, path, "c_custkey long, c_mktsegment string, c_acctbal double")


@query("A21_literal_table", "SELECT * FROM (VALUES ('ssp245', 2053), ('ssp370', 2047), ('ssp585', 2042)) t(scenario, year)")
def a21(spark, d):
    return scan.literal(spark, [("ssp245", 2053), ("ssp370", 2047), ("ssp585", 2042)], "scenario string, year int")


@query("S01_parquet_sink", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def s01(spark, d):
    path = sinks.export(scan.table(spark, d, "nation"), scratch(spark), "parquet", "data", ["n_regionkey"])
    sinks.export(scan.table(spark, d, "nation").limit(0), path, "parquet", "skip_existing")
    return spark.read.parquet(path).groupBy(F.col("n_regionkey").cast("int")).agg(F.count("*").alias("n"))


@query("S04_csv_sink", "SELECT s_suppkey, s_acctbal FROM supplier")
def s04(spark, d):
    path = sinks.export(scan.table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), scratch(spark), "csv", "data")
    return scan.csv(spark, path, "s_suppkey long, s_acctbal double")


@query("B02_label_selection", "SELECT sim, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_returnflag || l_linestatus AS sim FROM lineitem) WHERE sim IN ('AF', 'NO') GROUP BY 1")
def b02(spark, d):
    li = scan.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("sim"))
    return li.where(F.col("sim").isin("AF", "NO")).groupBy("sim").agg(F.count("*").alias("n"))


@query("B03_stride", f"WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY time) - 1 AS i FROM daily) SELECT sim, time, value FROM r WHERE i % 30 = 0")
def b03(spark, d):
    return subset.nth(scan.daily(spark, d), ["sim"], stride=30).select("sim", "time", "value")


@query("B04_time_slice", "SELECT l_linestatus AS s, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1998-09-16' GROUP BY 1")
def b04(spark, d):
    return subset.time_slice(scan.table(spark, d, "lineitem"), "March 1996", "1998-09-15", "l_shipdate").groupBy(F.col("l_linestatus").alias("s")).agg(F.count("*").alias("n"))


@query("B06_box", f"WITH {GRID} SELECT cell, year, round(avg(value), 6) AS value FROM grid WHERE lat BETWEEN 33 AND 35 AND lon BETWEEN -119 AND -117 GROUP BY 1, 2")
def b06(spark, d):
    return subset.box(scan.grid(spark, d), (33, 35), (-119, -117)).groupBy("cell", "year").agg(F.round(F.avg("value"), 6).alias("value"))


@query("B10_mask_keeps_rows", f"WITH {DAILY} SELECT sim, CAST(count(*) AS BIGINT) AS rows, CAST(count(CASE WHEN value > 30000 THEN value END) AS BIGINT) AS kept FROM daily GROUP BY 1")
def b10(spark, d):
    df = scan.daily(spark, d).withColumn("m", subset.mask(F.col("value"), F.col("value") > 30000))
    return df.groupBy("sim").agg(F.count("*").alias("rows"), F.count("m").alias("kept"))


@query("B13_date_parts", "SELECT CAST(month(o_orderdate) AS INT) AS month, CAST(count(*) AS BIGINT) AS n FROM orders WHERE month(o_orderdate) IN (1, 2, 12) AND NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29) GROUP BY 1")
def b13(spark, d):
    df = subset.date_parts(scan.table(spark, d, "orders"), months=[12, 1, 2], leap_day=False, time="o_orderdate")
    return df.groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query("B14_noleap_calendar", "SELECT CAST(dayofyear(t) - CASE WHEN leap AND month(t) > 2 THEN 1 ELSE 0 END AS INT) AS doy, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderdate AS t, year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) AS leap FROM orders) WHERE NOT (month(t) = 2 AND day(t) = 29) GROUP BY 1")
def b14(spark, d):
    return scan.table(spark, d, "orders").select(N.noleap_day(F.col("o_orderdate")).alias("doy")).where("doy is not null").groupBy("doy").agg(F.count("*").alias("n"))


@query("B16_live_series", f"WITH {DAILY}, m AS (SELECT sim, CASE WHEN sim <> 'AF' THEN value END AS value FROM daily) SELECT sim, CAST(count(*) AS BIGINT) AS n FROM m WHERE sim IN (SELECT sim FROM m WHERE value IS NOT NULL) GROUP BY 1")
def b16(spark, d):
    df = scan.daily(spark, d).withColumn("value", F.when(F.col("sim") != "AF", F.col("value")))
    return subset.live_series(df, ["sim"]).groupBy("sim").agg(F.count("*").alias("n"))


@query("B18_threshold_direction", f"WITH {DAILY} SELECT sim, CAST(sum(CASE WHEN value >= 40000 THEN 1 ELSE 0 END) AS BIGINT) AS above, CAST(sum(CASE WHEN value < 30000 THEN 1 ELSE 0 END) AS BIGINT) AS below FROM daily GROUP BY 1")
def b18(spark, d):
    v = F.col("value")
    return scan.daily(spark, d).groupBy("sim").agg(F.count_if(N.beyond(v, 40000, ">=")).alias("above"), F.count_if(N.beyond(v, 30000, "<")).alias("below"))


@query("B19_boolean_algebra", f"WITH {DAILY} SELECT sim, CAST(count(*) FILTER (WHERE (rain > 100 AND wind > 0.05) OR NOT (value > 20000)) AS BIGINT) AS n FROM daily GROUP BY 1")
def b19(spark, d):
    flag = (N.beyond(F.col("rain"), 100) & N.beyond(F.col("wind"), 0.05)) | ~N.beyond(F.col("value"), 20000)
    return scan.daily(spark, d).groupBy("sim").agg(F.count_if(flag).alias("n"))


@query("B22_first_of_duplicates", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def b22(spark, d):
    return subset.first_of(scan.table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("B23_convert_units", "SELECT o_orderpriority AS gcm, 'degF' AS units, round(avg(o_totalprice / 1000 * 1.8 - 459.67), 6) AS value FROM orders GROUP BY 1")
def b23(spark, d):
    base = catalog.from_frame(as_catalog(spark, d).get().withColumn("value", F.col("value") / 1000))
    return base.processes({"convert_units": "degF"}).get().groupBy("gcm", "units").agg(F.round(F.avg("value"), 6).alias("value"))


@query("B27_warming_windows", f"""WITH {YEARLY}, c AS (SELECT scenario, gcm, l AS warming_level, min(CASE WHEN value > l THEN year END) AS crossing FROM yearly, (VALUES (150000.0), (190000.0)) t(l) GROUP BY 1, 2, 3),
w AS (SELECT s.scenario, s.gcm, s.time, s.value, c.warming_level, c.crossing FROM scen s JOIN c USING (scenario, gcm) WHERE s.time >= make_date(c.crossing - 1, 1, 1) AND s.time < make_date(c.crossing + 1, 1, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY scenario, gcm, warming_level ORDER BY time) - 1 - count(*) OVER (PARTITION BY scenario, gcm, warming_level) // 2 AS time_delta FROM w)
SELECT scenario, gcm, CAST(warming_level AS DOUBLE) AS warming_level, CAST(min(time_delta) AS INT) AS first, CAST(max(time_delta) AS INT) AS last, round(avg(value), 5) AS value FROM r WHERE month(time) IN (6, 7, 8) GROUP BY 1, 2, 3""")
def b27(spark, d):
    keys = ["scenario", "gcm"]
    cross = warming.crossings(yearly(spark, d), [150000.0, 190000.0], keys)
    rows = warming.window_around(scan.scenarios(spark, d), cross, keys, half=1, months=[6, 7, 8])
    return rows.groupBy(*keys, "warming_level").agg(F.min("time_delta").alias("first"), F.max("time_delta").alias("last"), F.round(F.avg("value"), 5).alias("value"))


@query("B28_local_time", f"WITH {HOURLY} SELECT CAST(hour(time - INTERVAL 8 HOUR) AS INT) AS hour, CAST(count(*) AS BIGINT) AS n FROM hourly GROUP BY 1")
def b28(spark, d):
    return subset.local_time(scan.hourly(spark, d), "America/Los_Angeles").groupBy(F.hour("time").alias("hour")).agg(F.count("*").alias("n"))


@query("B29_clamp", f"WITH {DAILY} SELECT sim, min(least(greatest(value, 20000), 50000)) AS lo, max(least(greatest(value, 20000), 50000)) AS hi FROM daily GROUP BY 1")
def b29(spark, d):
    c = N.clamp(F.col("value"), 20000.0, 50000.0)
    return scan.daily(spark, d).groupBy("sim").agg(F.min(c).alias("lo"), F.max(c).alias("hi"))


@query("B36_custom_updates", f"WITH {HOURLY} SELECT h.sim, round(sum(coalesce(u.v, h.value)), 4) AS total FROM hourly h LEFT JOIN (VALUES ('click', TIMESTAMP '2024-01-05 03:00:00', 1000.0), ('view', TIMESTAMP '2024-01-06 00:00:00', 500.0)) u(sim, time, v) ON h.sim = u.sim AND h.time = u.time GROUP BY 1")
def b36(spark, d):
    new = scan.literal(spark, [("click", "2024-01-05 03:00:00", 1000.0), ("view", "2024-01-06 00:00:00", 500.0)], "sim string, t string, value double").select("sim", F.col("t").cast("timestamp_ntz").alias("time"), "value")
    return subset.update_at(scan.hourly(spark, d), new, ["sim", "time"]).groupBy("sim").agg(F.round(F.sum("value"), 4).alias("total"))


@query("C01_aligned_arithmetic", f"WITH {DAILY} SELECT a.time, round(a.value - b.value, 6) AS value FROM daily a JOIN daily b ON a.time = b.time WHERE a.sim = 'AF' AND b.sim = 'NO'")
def c01(spark, d):
    df = scan.daily(spark, d)
    return joins.aligned(df.where("sim = 'AF'"), df.where("sim = 'NO'"), ["time"], lambda a, b: F.round(a - b, 6))


@query("C02_merge_variables", f"WITH {DAILY} SELECT coalesce(a.time, b.time) AS time, a.value AS price, b.rain AS rain FROM (SELECT * FROM daily WHERE sim = 'AF') a FULL JOIN (SELECT * FROM daily WHERE sim = 'RF' AND rain > 50) b ON a.time = b.time")
def c02(spark, d):
    df = scan.daily(spark, d)
    return joins.merge({"price": df.where("sim = 'AF'"), "rain": df.where("sim = 'RF' and rain > 50").select("time", F.col("rain").alias("value"))}, ["time"])


@query("C04_minus_climatology", f"WITH {MONTHLY}, c AS (SELECT scenario, gcm, month(time) AS m, quantile_cont(value, 0.5) AS clim FROM monthly WHERE year(time) BETWEEN 1995 AND 1997 GROUP BY 1, 2, 3) SELECT s.scenario, s.gcm, s.time, round(s.value - c.clim, 6) AS anomaly FROM monthly s JOIN c ON s.scenario = c.scenario AND s.gcm = c.gcm AND month(s.time) = c.m")
def c04(spark, d):
    m = monthly(spark, d).withColumn("month", F.month("time"))
    clim = m.where(F.year("time").between(1995, 1997)).groupBy("scenario", "gcm", "month").agg(F.percentile("value", F.lit(0.5)).alias("value"))
    return joins.minus_climatology(m, clim, ["scenario", "gcm", "month"]).select("scenario", "gcm", "time", F.round("anomaly", 6).alias("anomaly"))


@query("C05_threshold_lookup", f"WITH {DAILY}, t AS (SELECT sim, quantile_cont(value, 0.9) AS q FROM daily GROUP BY 1) SELECT sim, CAST(count(*) AS BIGINT) AS n FROM daily JOIN t USING (sim) WHERE value > q GROUP BY 1")
def c05(spark, d):
    df = scan.daily(spark, d)
    limit = df.groupBy("sim").agg(F.percentile("value", F.lit(0.9)).alias("q"))
    return joins.lookup(df, limit, ["sim"]).where("value > q").groupBy("sim").agg(F.count("*").alias("n"))


@query("C06_dimension_lookup", "SELECT r_name, CAST(count(*) AS BIGINT) AS n, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def c06(spark, d):
    s = scan.table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    n = scan.table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    out = joins.lookup(joins.lookup(s, n, ["n_nationkey"]), scan.table(spark, d, "region"), ["r_regionkey"])
    return out.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("C07_interval_join", "SELECT w.label, CAST(count(*) AS BIGINT) AS n, round(sum(p_retailprice), 2) AS total FROM part JOIN (VALUES ('a', 900.0, 1100.5), ('b', 1000.0, 1500.0), ('c', 1450.25, 2100.0)) w(label, first, last) ON p_retailprice >= w.first AND p_retailprice < w.last GROUP BY 1")
def c07(spark, d):
    w = scan.literal(spark, [("a", 900.0, 1100.5), ("b", 1000.0, 1500.0), ("c", 1450.25, 2100.0)], "label string, first double, last double")
    return joins.in_bins(scan.table(spark, d, "part"), w, "p_retailprice", 100.0).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("C08_nearest_cell", f"WITH {GRID}, c AS (SELECT DISTINCT cell, lat, lon FROM grid), p(point, lat, lon) AS (VALUES (1, 33.1, -118.2), (2, 35.74, -116.6), (3, 32.0, -119.9)), d AS (SELECT p.point, c.cell, power(c.lat - p.lat, 2) + power(c.lon - p.lon, 2) AS d2 FROM p, c) SELECT point, arg_min(cell, (round(d2, 9), cell)) AS cell FROM d GROUP BY 1")
def c08(spark, d):
    points = scan.literal(spark, [(1, 33.1, -118.2), (2, 35.74, -116.6), (3, 32.0, -119.9)], "point int, lat double, lon double")
    cells = scan.grid(spark, d).select("cell", "lat", "lon").distinct()
    return joins.nearest_cell(points, cells, "point", "cell", 6.0).select("point", "cell")


@query("C08_nearest_in_time", f"WITH {HOURLY}, m(moment) AS (VALUES (TIMESTAMP '2024-01-10 12:20:00'), (TIMESTAMP '2024-01-20 00:00:00')) SELECT sim, moment, arg_min(value, (abs(epoch_us(time) - epoch_us(moment)), time)) AS value FROM hourly, m GROUP BY 1, 2")
def c08b(spark, d):
    h = scan.hourly(spark, d)
    wanted = F.array(*[F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10 12:20:00", "2024-01-20 00:00:00")])
    moments = h.select("sim").distinct().select("sim", F.explode(wanted).alias("moment"))
    return joins.nearest_in_time(h, moments, ["sim"]).select("sim", "moment", "value")


@query("C09_point_in_polygon", f"WITH {GRID}, c AS (SELECT DISTINCT cell, lat, lon FROM grid) SELECT cell, CASE WHEN lat > 32.2 AND lat < 34.2 AND lon > -120.2 AND lon < -117.8 THEN 1 ELSE 2 END AS region_id FROM c WHERE (lat > 32.2 AND lat < 34.2 AND lon > -120.2 AND lon < -117.8) OR (lat > 33.7 AND lat < 36.2 AND lon > -118.6 AND lon < -116.3)")
def c09(spark, d):
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    polygons = scan.literal(spark, [(1, box(-120.2, 32.2, -117.8, 34.2)), (2, box(-118.6, 33.7, -116.3, 36.2))], "region_id int, ring array<struct<lon: double, lat: double>>")
    return geo.regions_of_points(scan.grid(spark, d).select("cell", "lat", "lon").distinct(), polygons, "cell")


@query("C10_land_only_nearest", f"WITH {GRID}, c AS (SELECT DISTINCT cell, lat, lon FROM grid WHERE cell % 3 <> 0), p(point, lat, lon) AS (VALUES (1, 33.1, -118.2), (2, 35.74, -116.6)), d AS (SELECT p.point, c.cell, power(c.lat - p.lat, 2) + power(c.lon - p.lon, 2) AS d2 FROM p, c) SELECT point, arg_min(cell, (round(d2, 9), cell)) AS cell FROM d GROUP BY 1")
def c10(spark, d):
    points = scan.literal(spark, [(1, 33.1, -118.2), (2, 35.74, -116.6)], "point int, lat double, lon double")
    cells = scan.grid(spark, d).select("cell", "lat", "lon").distinct()
    return joins.nearest_cell(points, cells, "point", "cell", 6.0, only=F.col("cell") % 3 != 0).select("point", "cell")


@query("C11_semi_join", "SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996 AND o_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000)")
def c11(spark, d):
    o = scan.table(spark, d, "orders")
    return joins.keep_common(o.where(F.year("o_orderdate") == 1996), o.where(F.year("o_orderdate") == 2000), ["o_custkey"]).select("o_custkey").distinct()


@query("C12_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)")
def c12(spark, d):
    o = scan.table(spark, d, "orders").where(F.year("o_orderdate") == 1997).withColumnRenamed("o_custkey", "c_custkey")
    return joins.keep_missing(scan.table(spark, d, "customer"), o, ["c_custkey"]).select("c_custkey")


@query("C14_history_with_scenarios", f"WITH {YEARLY}, p AS (SELECT * FROM yearly WHERE scenario = 'F'), f AS (SELECT * FROM yearly WHERE scenario <> 'F' AND gcm IN (SELECT gcm FROM p)) SELECT scenario, gcm, year, value, 'scenario' AS segment FROM f UNION ALL SELECT k.scenario, p.gcm, p.year, p.value, 'historical' FROM p JOIN (SELECT DISTINCT gcm, scenario FROM f) k ON k.gcm = p.gcm")
def c14(spark, d):
    return joins.history_with_scenarios(yearly(spark, d), ["gcm"], history="F").select("scenario", "gcm", "year", "value", "segment")


@query("F03_top_models", "WITH p AS (SELECT DISTINCT c_mktsegment AS gcm, c_nationkey AS member FROM customer), n AS (SELECT gcm, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, gcm LIMIT 3), r AS (SELECT p.gcm, p.member, n.n, row_number() OVER (PARTITION BY p.gcm ORDER BY p.member) AS place FROM p JOIN n USING (gcm)) SELECT gcm, member, n, CAST(place AS INT) AS place FROM r WHERE place <= 4")
def f03(spark, d):
    from ..operators import ensemble

    c = scan.table(spark, d, "customer").select(F.col("c_mktsegment").alias("gcm"), F.col("c_nationkey").alias("member"))
    return ensemble.largest_models(c, 3, 4)


@query("F05_pick_simulations", f"""WITH {YEARLY}, m AS (SELECT scenario || '_' || gcm AS sim, avg(value) AS metric FROM yearly GROUP BY 1), r AS (SELECT sim, metric, row_number() OVER (ORDER BY metric, sim) AS p, count(*) OVER () AS n FROM m)
SELECT sim, round(metric, 5) AS metric, label FROM (SELECT sim, metric, p, n, unnest(['min', 'q25', 'median', 'q75', 'max', 'middle']) AS label FROM r)
WHERE p = CASE label WHEN 'min' THEN 1 WHEN 'q25' THEN ceil(n * 0.25) WHEN 'median' THEN ceil(n * 0.5) WHEN 'q75' THEN ceil(n * 0.75) WHEN 'max' THEN n END OR (label = 'middle' AND abs((p - 0.5) / n - 0.5) <= 0.05)""")
def f05(spark, d):
    m = yearly(spark, d).groupBy(F.concat_ws("_", "scenario", "gcm").alias("sim")).agg(F.avg("value").alias("metric"))
    return subset.pick_simulations(m, "sim", "metric").withColumn("metric", F.round("metric", 5))


@query("G01_union_by_name", "SELECT 'customer' AS kind, c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def g01(spark, d):
    c = scan.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    s = scan.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return subset.union_all({"customer": c, "supplier": s}, "kind")


@query("G03_joined_calendar", f"WITH {MONTHLY}, u AS (SELECT scenario, gcm, time, value, 'baseline' AS segment FROM monthly WHERE year(time) <= 1997 UNION ALL SELECT scenario, gcm, time, value, 'future' FROM monthly WHERE year(time) >= 1999), r AS (SELECT *, row_number() OVER (PARTITION BY scenario, gcm ORDER BY segment, time) - 1 AS step FROM u) SELECT scenario, gcm, segment, CAST(min(step) AS INT) AS first, CAST(max(step) AS INT) AS last FROM r GROUP BY 1, 2, 3")
def g03(spark, d):
    m = monthly(spark, d)
    both = subset.joined_calendar(m.where(F.year("time") <= 1997), m.where(F.year("time") >= 1999), ["scenario", "gcm"])
    return both.groupBy("scenario", "gcm", "segment").agg(F.min("step").alias("first"), F.max("step").alias("last"))


@query("G04_intersect", "SELECT l_suppkey FROM lineitem WHERE year(l_shipdate) = 1996 INTERSECT SELECT l_suppkey FROM lineitem WHERE year(l_shipdate) = 2000")
def g04(spark, d):
    li = scan.table(spark, d, "lineitem")
    return li.where(F.year("l_shipdate") == 1996).select("l_suppkey").intersect(li.where(F.year("l_shipdate") == 2000).select("l_suppkey"))


@query("G05_except", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def g05(spark, d):
    return scan.table(spark, d, "part").select("p_partkey").exceptAll(scan.table(spark, d, "lineitem").where("l_quantity > 40").select("l_partkey").distinct())


@query("G06_union_distinct", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity = 1 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000")
def g06(spark, d):
    return scan.table(spark, d, "lineitem").where("l_quantity = 1").select(F.col("l_suppkey").alias("k")).union(scan.table(spark, d, "supplier").where("s_acctbal > 5000").select("s_suppkey")).distinct()


@query("H02_pivot", f"WITH {HOURLY} SELECT CAST(dayofyear(time) AS INT) AS doy, round(avg(CASE WHEN hour(time) = 0 THEN value END), 4) AS h0, round(avg(CASE WHEN hour(time) = 6 THEN value END), 4) AS h6, round(avg(CASE WHEN hour(time) = 12 THEN value END), 4) AS h12, round(avg(CASE WHEN hour(time) = 18 THEN value END), 4) AS h18 FROM hourly GROUP BY 1")
def h02(spark, d):
    p = scan.hourly(spark, d).withColumn("hour", F.hour("time")).groupBy(F.dayofyear("time").alias("doy")).pivot("hour", [0, 6, 12, 18]).agg(F.round(F.avg("value"), 4))
    return p.withColumnsRenamed({str(h): f"h{h}" for h in (0, 6, 12, 18)})


@query("H04_unpivot", f"WITH {DAILY} SELECT sim, variable, round(sum(value), 3) AS total FROM (SELECT sim, 'tmax' AS variable, tmax AS value FROM daily UNION ALL SELECT sim, 'tmin', tmin FROM daily) GROUP BY 1, 2")
def h04(spark, d):
    return scan.daily(spark, d).unpivot(["sim"], ["tmax", "tmin"], "variable", "value").groupBy("sim", "variable").agg(F.round(F.sum("value"), 3).alias("total"))


@query("H08_date_from_parts", "SELECT make_date(1994 + CAST(p_size % 7 AS INT), 1 + CAST(p_size % 12 AS INT), 1 + CAST(p_size % 28 AS INT)) AS day, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def h08(spark, d):
    s = F.col("p_size")
    return scan.table(spark, d, "part").groupBy(F.make_date(1994 + s % 7, 1 + s % 12, 1 + s % 28).alias("day")).agg(F.count("*").alias("n"))


@query("I01_parse_simulation_names", "SELECT n AS sim, split_part(n, '_', 3) AS gcm, split_part(n, '_', 4) AS scenario, CASE WHEN len(string_split(n, '_')) >= 7 THEN split_part(n, '_', 7) ELSE split_part(n, '_', 5) END AS member FROM (VALUES ('WRF_UCLA_EC-Earth3_ssp370_day_d03_r1i1p1f1'), ('wrf_ucla_cesm2_ssp245_r11i1p1f1')) t(n)")
def i01(spark, d):
    df = scan.literal(spark, [("WRF_UCLA_EC-Earth3_ssp370_day_d03_r1i1p1f1",), ("wrf_ucla_cesm2_ssp245_r11i1p1f1",)], "sim string")
    return N.parse_sim(df).select("sim", "gcm", "scenario", "member")


@query("I02_guarded_division", f"WITH {DAILY} SELECT sim, round(avg(value / greatest(rain - 60, 10)), 6) AS floored, round(avg(CASE WHEN rain <> 30 THEN value / (rain - 30) END), 6) AS guarded FROM daily GROUP BY 1")
def i02(spark, d):
    r = F.col("rain")
    return scan.daily(spark, d).groupBy("sim").agg(F.round(F.avg(N.guarded(F.col("value"), r - 60, 10.0)), 6).alias("floored"), F.round(F.avg(N.guarded(F.col("value"), r - 30)), 6).alias("guarded"))


@query("I03_seasons_and_water_years", "SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INT) AS wy, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) <= 5 THEN 'MAM' WHEN month(o_orderdate) <= 8 THEN 'JJA' ELSE 'SON' END AS season, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def i03(spark, d):
    t = F.col("o_orderdate")
    return scan.table(spark, d, "orders").groupBy(N.water_year(t).alias("wy"), N.season(t).alias("season")).agg(F.count("*").alias("n"))


@query("I04_json_property", "SELECT CAST(json_extract(props, '$.k') AS INT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def i04(spark, d):
    return scan.table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("K01_derived_variable", "SELECT o_orderkey % 997 AS station, round(sqrt(power(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END) / 1e5, 2) + power(sum(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice ELSE 0 END) / 1e5, 2)), 6) AS wind_speed_10m FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 2) = 2")
def k01(spark, d):
    o = scan.table(spark, d, "orders")
    long = o.groupBy((F.col("o_orderkey") % 997).alias("station"), F.when(F.col("o_orderkey") % 2 == 0, "u10").otherwise("v10").alias("variable")).agg((F.sum("o_totalprice") / 1e5).alias("value"))
    df = catalog.from_frame(long).variable("wind_speed_10m").get().where("wind_speed_10m is not null")
    return df.select("station", F.round("wind_speed_10m", 6).alias("wind_speed_10m"))


@query("J28_heat_index", f"""WITH {HOURLY}, b AS (SELECT sim, time, 70 + value % 45 AS t, 5 + (value * 7) % 95 AS rh FROM hourly), s AS (SELECT *, 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + rh * 0.094) AS simple,
-42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t - 0.05481717 * rh * rh + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh AS full_hi FROM b)
SELECT sim, CAST(time AS DATE) AS day, round(max(CASE WHEN (simple + t) / 2 >= 80 THEN full_hi - CASE WHEN rh < 13 AND t >= 80 AND t <= 112 THEN (13.0 - rh) / 4.0 * sqrt(greatest(0.0, (17.0 - abs(t - 95.0)) / 17.0)) ELSE 0 END
+ CASE WHEN rh > 85 AND t >= 80 AND t <= 87 THEN (rh - 85.0) / 10.0 * ((87.0 - t) / 5.0) ELSE 0 END ELSE simple END), 5) AS heat_index FROM s GROUP BY 1, 2""")
def j28(spark, d):
    b = scan.hourly(spark, d).withColumn("t", 70 + F.col("value") % 45).withColumn("rh", 5 + (F.col("value") * 7) % 95)
    return b.groupBy("sim", F.to_date("time").alias("day")).agg(F.round(F.max(X.heat_index(F.col("t"), F.col("rh"))), 5).alias("heat_index"))


@query("J31_sea_level_pressure", "SELECT s_suppkey AS station, round((95000 + s_acctbal / 10) / 100.0 * exp(9.80665 * (s_suppkey % 500) / (287.05 * ((285 + s_suppkey % 20) * (1 + 0.61 * 0.008) + 0.0065 * (s_suppkey % 500) / 2))), 6) AS slp FROM supplier")
def j31(spark, d):
    k = F.col("s_suppkey")
    slp = X.sea_level_pressure(95000 + F.col("s_acctbal") / 10, 285 + k % 20, F.lit(0.008), k % 500)
    return scan.table(spark, d, "supplier").select(k.alias("station"), F.round(slp, 6).alias("slp"))


@query("J33_pet_fao56", """WITH b AS (SELECT s_suppkey AS station, 5.0 + s_suppkey % 10 AS tn, 18.0 + s_suppkey % 17 AS tx, 30.0 + s_suppkey % 60 AS rh, 8.0 + s_suppkey % 9 AS rn, 1.0 + s_suppkey % 6 AS w FROM supplier),
c AS (SELECT *, (tn + tx) / 2 AS t, (0.6108 * exp(17.27 * tn / (tn + 237.3)) + 0.6108 * exp(17.27 * tx / (tx + 237.3))) / 2 AS es, w * 0.748 AS u2, 0.000665 * 101.3 AS g FROM b),
e AS (SELECT *, es * rh / 100 AS ea, 4098 * 0.6108 * exp(17.27 * t / (t + 237.3)) / power(t + 237.3, 2) AS delta FROM c)
SELECT station, round(greatest(0, (0.408 * delta * rn + g * 900 / (t + 273) * u2 * (es - ea)) / (delta + g * (1 + 0.34 * u2))), 6) AS pet FROM e""")
def j33(spark, d):
    k = F.col("s_suppkey")
    pet = X.pet_fao56(5.0 + k % 10, 18.0 + k % 17, 30.0 + k % 60, 8.0 + k % 9, 1.0 + k % 6)
    return scan.table(spark, d, "supplier").select(k.alias("station"), F.round(pet, 6).alias("pet"))
