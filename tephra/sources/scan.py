"""Scans: Parquet, CSV with declared schemas, literal tables, and the test tables in the roles of climate data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numbers import nan_to_null

LONG_SCHEMA = (
    "activity string, institution string, gcm string, member string, scenario string, sim string, table_id string, grid_label string, variable string, units string, "
    "warming_level double, time timestamp_ntz, time_delta int, y int, x int, lat double, lon double, pressure_level int, value double"
)
#: Names that other files give to the same dimensions.
DIMENSIONS = {"simulation": "sim", "longitude": "lon", "latitude": "lat", "datetime": "time"}


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Several paths read as one; NaN becomes NULL and dimensions get their usual names."""
    df = nan_to_null(spark.read.parquet(*paths))
    return df.withColumnsRenamed({a: b for a, b in DIMENSIONS.items() if a in df.columns and b not in df.columns})


def listing(spark: SparkSession, folder: str, files: str = "*") -> DataFrame:
    """(path, bytes) of the files below a folder whose names match; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """CSV by position under a declared schema, so a byte-order mark or repeated names in the header don't matter."""
    return nan_to_null(spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("nanValue", "NaN").csv(path))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series of six simulations: sim, time, value, rain, wind, tmax, tmin."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("sim"), F.to_date("l_shipdate").alias("time")).agg(
        F.round(F.avg("l_extendedprice"), 7).alias("value"), F.sum("l_quantity").alias("rain"), F.round(F.avg("l_discount"), 7).alias("wind"),
        F.max("l_extendedprice").alias("tmax"), F.min("l_extendedprice").alias("tmin"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series of five simulations: sim, time, value."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("sim"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("time")).agg(F.round(F.avg("value"), 7).alias("value"))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series by scenario and gcm: scenario, gcm, time, value."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("scenario"), F.col("o_orderpriority").alias("gcm"), F.to_date("o_orderdate").alias("time")).agg(F.round(F.avg("o_totalprice"), 7).alias("value"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly values on a grid of cells: sim, cell, lat, lon, year, value."""
    li = table(spark, sf_dir, "lineitem")
    cells = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("sim"), F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("year")).agg(F.round(F.avg("l_extendedprice"), 7).alias("value"))
    return cells.withColumns({"lat": 32.0 + F.col("cell") % 10 * 0.5, "lon": -120.0 + F.floor(F.col("cell") / 10) % 10 * 0.5})
