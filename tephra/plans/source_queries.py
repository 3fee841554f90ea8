"""Queries for boundary files, users' own files, listings and sinks: written from the test tables, then read back."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from ..operators import geo, subset
from ..sources import catalog, scan, shapes, sinks
from .base import DAILY, GRID, query
from .subset_queries import as_catalog, scratch

CELLS = f"{GRID}, c AS (SELECT DISTINCT cell, lat, lon FROM grid)"
BOXES = f"WITH {CELLS} SELECT cell AS region_id, lon - 0.25 AS west, lon + 0.25 AS east, lat - 0.125 AS south, lat + 0.125 AS north FROM c"


def boxes(spark, d):
    """A rectangle around each cell."""
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    ring = F.array(corner(-0.25, -0.125), corner(0.25, -0.125), corner(0.25, 0.125), corner(-0.25, 0.125))
    return scan.grid(spark, d).select("cell", "lat", "lon").distinct().select(F.col("cell").alias("region_id"), ring.alias("ring"))


def sides(polygons):
    return geo.bounds(polygons).select("region_id", "west", "east", "south", "north")


@query("A13_geoparquet_scan", BOXES)
def a13(spark, d):
    path = scratch(spark)
    boxes(spark, d).select("region_id", shapes.wkb_of(F.array("ring")).alias("geometry")).write.parquet(path)
    return sides(shapes.rings_from_wkb(scan.parquet(spark, path)))


@query("A14_zipped_shapefile_scan", BOXES)
def a14(spark, d):
    found = shapes.shapefile(spark, shapes.to_shapefile(boxes(spark, d), scratch(spark) + ".zip"))
    return sides(found.select(F.col("attributes")["region_id"].cast("long").alias("region_id"), "part", "ring"))


@query("A15_named_boundaries", "SELECT n_nationkey AS geoid, n_name AS name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'ASIA' AND n_name IN ('NATION_2', 'NATION_7', 'NATION_12')")
def a15(spark, d):
    n, r = scan.table(spark, d, "nation"), scan.table(spark, d, "region")
    table = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("kind"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("geoid"))
    return shapes.named(table, "ASIA", ["nation_2", "Nation_7", "NATION_12", "nation_1"]).select("geoid", "name")


@query("A17_file_listing", "SELECT DISTINCT CAST(n_regionkey AS INT) AS n_regionkey, CAST(1 AS BIGINT) AS files, true AS filled FROM nation")
def a17(spark, d):
    path = sinks.export(scan.table(spark, d, "nation").coalesce(1), scratch(spark), "parquet", "data", ["n_regionkey"])
    key = F.regexp_extract("path", "n_regionkey=([0-9]+)/", 1).cast("int")
    return scan.listing(spark, path, "*.parquet").groupBy(key.alias("n_regionkey")).agg(F.count("*").alias("files"), F.bool_and(F.col("bytes") > 0).alias("filled"))


@query("A18_selection_object", "SELECT o_orderkey % 4 AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def a18(spark, d):
    chosen = SimpleNamespace(scenario="O", variable="t2", gcm=["1-URGENT", "2-HIGH"], member=None, grid_label="", resolution="ignored")
    keyed = scan.table(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("k"), F.col("o_orderstatus").alias("scenario"), F.col("o_orderpriority").alias("gcm"), F.when(F.col("o_orderkey") % 2 == 0, "t2").otherwise("rh").alias("variable"), F.col("o_totalprice").alias("value"))
    return catalog.from_selection(catalog.from_frame(keyed), chosen).get().groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("A22_user_file", f"WITH {DAILY} SELECT sim, count(*) AS n, round(sum(value), 2) AS total FROM daily WHERE time BETWEEN DATE '1994-01-01' AND DATE '1995-12-31' GROUP BY 1")
def a22(spark, d):
    path = scratch(spark)
    scan.daily(spark, d).select(F.col("sim").alias("simulation"), F.lit(2.0).alias("warming_level"), F.col("time").alias("datetime"), "value").write.parquet(path)
    own = catalog.from_file(spark, path).processes({"time_slice": ("1994", "1995")}).get()
    return own.groupBy("sim").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("B32_zones_from_coordinates", f"""WITH {GRID} SELECT sim, cell, CASE WHEN lon < -117.25 THEN 'Etc/GMT+8' WHEN lon < -116.25 THEN 'Etc/GMT+7' ELSE 'Etc/GMT+8' END AS zone,
 make_timestamp(year, 1, 1, 0, 0, 0) - CASE WHEN lon < -117.25 THEN INTERVAL 8 HOUR WHEN lon < -116.25 THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS time FROM grid""")
def b32(spark, d):
    """Two zones as polygons; east of them the longitude decides."""
    zones = scan.literal(spark, [("Etc/GMT+8", "POLYGON ((-125 30, -117.25 30, -117.25 40, -125 40))"), ("Etc/GMT+7", "POLYGON ((-117.25 30, -116.25 30, -116.25 40, -117.25 40))")], "zone string, wkt string")
    grid = scan.grid(spark, d)
    cells = geo.zones_of(grid.select("cell", "lat", "lon").distinct(), geo.rings_from_wkt(zones, key="zone"), "cell")
    timed = grid.join(cells.select("cell", "zone"), "cell").withColumn("time", F.make_timestamp_ntz("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return subset.local_time(timed, F.col("zone")).select("sim", "cell", "zone", "time")


@query("B35_units_in_metadata", "SELECT 'degC' AS unit, count(*) AS n, round(sum(o_totalprice - 273.15), 2) AS total FROM orders WHERE o_orderkey % 2 = 0")
def b35(spark, d):
    got = as_catalog(spark, d).variable("t2").processes({"convert_units": "degC"}).get()
    return got.agg(F.lit(got.schema["value"].metadata["units"]).alias("unit"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("S02_export_once", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3")
def s02(spark, d):
    """A second export to the same path leaves the first as it is."""
    n = scan.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = sinks.export(n.where("n_regionkey < 3").drop("n_regionkey"), scratch(spark), "parquet", "skip_existing")
    return spark.read.parquet(sinks.export(n.drop("n_regionkey"), path, "parquet", "skip_existing"))


@query("S07_weather_file_lines", "SELECT 'LOCATION,here,34.0,-118.0' AS line UNION ALL SELECT 'hour_of_year,n' UNION ALL SELECT hour(ts) || ',' || count(*) FROM events GROUP BY hour(ts)")
def s07(spark, d):
    hours = scan.table(spark, d, "events").groupBy(F.hour(F.col("ts")).cast("int").alias("hour_of_year")).agg(F.count("*").alias("n"))
    return spark.read.text(sinks.weather_file(hours, scratch(spark), "here", 34.0, -118.0, ["hour_of_year", "n"])).withColumnRenamed("value", "line")
