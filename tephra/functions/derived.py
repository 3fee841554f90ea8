"""Derived variables that queries can name, registered on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.catalog import register
from . import weather

register("heat_index", ["t2_degF", "rh"], lambda df: df.withColumn("heat_index", weather.heat_index(F.col("t2_degF"), F.col("rh"))), "apparent temperature, degF")
register("wind_speed_10m", ["u10", "v10"], lambda df: df.withColumn("wind_speed_10m", weather.wind_speed(F.col("u10"), F.col("v10"))), "m/s")
register("wind_direction_10m", ["u10", "v10"], lambda df: df.withColumn("wind_direction_10m", weather.wind_direction(F.col("u10"), F.col("v10"))), "degrees, where the wind is from")
register("dew_point_2m", ["t2_degC", "rh"], lambda df: df.withColumn("dew_point_2m", weather.dew_point(F.col("t2_degC"), F.col("rh"))), "degC")
register("relative_humidity_2m", ["t2_degC", "td2_degC"], lambda df: df.withColumn("relative_humidity_2m", weather.relative_humidity(F.col("t2_degC"), F.col("td2_degC"))), "percent")
