"""Polygons and grids: point in polygon, masks, map projection, cell outlines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges_of(polygons: DataFrame, key: str = "region_id", ring: str = "ring") -> DataFrame:
    """(key, part, x1, y1, x2, y2) from rings of (lon, lat) structs; rings close by themselves."""
    parts = polygons.select(key, F.col("part") if "part" in polygons.columns else F.lit(0).alias("part"), F.col(ring).alias("r"))
    at = F.explode(F.sequence(F.lit(1), F.size("r"))).alias("i")
    following = F.when(F.col("i") == F.size("r"), 1).otherwise(F.col("i") + 1)
    e = parts.select(key, "part", "r", at).select(key, "part", F.element_at("r", F.col("i")).alias("a"), F.element_at("r", following).alias("b"))
    return e.select(key, "part", F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("b.lon").alias("x2"), F.col("b.lat").alias("y2"))


def rings_from_wkt(df: DataFrame, wkt: str = "wkt", key: str = "region_id") -> DataFrame:
    """(key, part, ring) for each outer ring of POLYGON and MULTIPOLYGON texts; inner rings follow as parts of their own."""
    bodies = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: F.struct(F.element_at(F.split(F.trim(p), r"\s+"), 1).cast("double").alias("lon"), F.element_at(F.split(F.trim(p), r"\s+"), 2).cast("double").alias("lat"))
    rows = df.select(key, F.posexplode(bodies).alias("part", "body"))
    return rows.select(key, "part", F.transform(F.split("body", ","), point).alias("ring"))


def regions_of_points(points: DataFrame, polygons: DataFrame, point_key: str, square: float = 1.0, key: str = "region_id", order: str | None = None) -> DataFrame:
    """(point_key, key): the first polygon, by `order`, that holds each point (lat, lon); points in none have no row.

    Ray casting as an aggregation: a point is inside if a ray to the east crosses the edges an odd number of times. Polygons are dealt to squares by their
    bounding boxes, points meet only polygons of their square."""
    order = order or key
    edges = edges_of(polygons, key)
    bounds = edges.groupBy(key, "part").agg(F.min("x1").alias("x0"), F.max("x1").alias("x9"), F.min("y1").alias("y0"), F.max("y1").alias("y9"))
    cell = lambda c: F.floor(c / square)
    dealt = bounds.withColumn("__x", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x9"))))).withColumn("__y", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y9")))))
    p = points.select(point_key, "lat", "lon").withColumn("__x", cell(F.col("lon"))).withColumn("__y", cell(F.col("lat")))
    near = p.join(dealt, ["__x", "__y"]).where((F.col("lon") > F.col("x0")) & (F.col("lon") < F.col("x9")) & (F.col("lat") > F.col("y0")) & (F.col("lat") < F.col("y9"))).select(point_key, "lat", "lon", key, "part")
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    east = F.col("lon") < (F.col("x2") - F.col("x1")) * F.try_divide(F.col("lat") - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1")
    hits = near.join(edges, [key, "part"]).groupBy(point_key, key, "part").agg((F.count_if(spans & east) % 2 == 1).alias("inside")).where("inside")
    hits = hits.select(point_key, key).distinct()
    if order != key:
        hits = hits.join(polygons.select(key, order).distinct(), key)
    return hits.groupBy(point_key).agg(F.min_by(key, F.col(order)).alias(key))


def region_mask(cells: DataFrame, polygons: DataFrame, cell_key: str, square: float = 1.0) -> DataFrame:
    """Every cell with its region, NULL outside."""
    return cells.join(regions_of_points(cells, polygons, cell_key, square), cell_key, "left")


def zones_of(points: DataFrame, zones: DataFrame, point_key: str, key: str = "zone", square: float = 5.0) -> DataFrame:
    """Every point (lat, lon) with the name of the time zone whose polygon holds it; outside all of them, the nautical zone of its longitude.

    Points without coordinates have no zone."""
    nautical = F.round(F.col("lon") / 15).cast("int")
    name = F.when(nautical == 0, "Etc/GMT").otherwise(F.concat(F.lit("Etc/GMT"), F.when(nautical > 0, "-").otherwise("+"), F.abs(nautical).cast("string")))
    return points.join(regions_of_points(points, zones, point_key, square, key), point_key, "left").withColumn(key, F.coalesce(key, name))


def flip_columns(mask: DataFrame, nx: int, x: str = "x") -> DataFrame:
    return mask.withColumn(x, F.lit(nx - 1) - F.col(x))


def lambert(lat: Column, lon: Column, lat0: float, lon0: float, lat1: float, lat2: float, radius: float = 6370000.0) -> tuple[Column, Column]:
    """(x, y) metres in a spherical Lambert conformal conic projection."""
    r = math.radians
    n = math.sin(r(lat1)) if lat1 == lat2 else math.log(math.cos(r(lat1)) / math.cos(r(lat2))) / math.log(math.tan(math.pi / 4 + r(lat2) / 2) / math.tan(math.pi / 4 + r(lat1) / 2))
    f = math.cos(r(lat1)) * math.tan(math.pi / 4 + r(lat1) / 2) ** n / n
    rho0 = radius * f / math.tan(math.pi / 4 + r(lat0) / 2) ** n
    rho = radius * f / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2), F.lit(n))
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def mercator(lat: Column, lon: Column, radius: float = 6378137.0) -> tuple[Column, Column]:
    return radius * F.radians(lon), radius * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def cell_outlines(cells: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds west, east, south and north of each cell, half way to its neighbours in its row and column; edge cells mirror their inner side.

    Cells of equal coordinates have one outline; a cell without both coordinates has none."""
    places = cells.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).distinct()
    row, column = Window.partitionBy(y).orderBy(x), Window.partitionBy(x).orderBy(y)
    after, before = (F.lead(x).over(row) - F.col(x)) / 2, (F.col(x) - F.lag(x).over(row)) / 2
    up, down = (F.lead(y).over(column) - F.col(y)) / 2, (F.col(y) - F.lag(y).over(column)) / 2
    outlines = places.withColumns({
        "west": F.col(x) - F.coalesce(before, after), "east": F.col(x) + F.coalesce(after, before),
        "south": F.col(y) - F.coalesce(down, up), "north": F.col(y) + F.coalesce(up, down),
    })
    return cells.join(outlines, [x, y], "left").select(*cells.columns, "west", "east", "south", "north")


def bounds(polygons: DataFrame, key: str = "region_id") -> DataFrame:
    """Bounding box and mean of the corner points of each region, over all its parts."""
    e = edges_of(polygons, key)
    return e.groupBy(key).agg(F.min("x1").alias("west"), F.max("x1").alias("east"), F.min("y1").alias("south"), F.max("y1").alias("north"), F.avg("x1").alias("mean_lon"), F.avg("y1").alias("mean_lat"))
