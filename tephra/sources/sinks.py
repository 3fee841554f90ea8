"""Sinks: Parquet, CSV with a metadata file, partitioned bundles, weather files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.subset import expand_name

MODES = {"data": "overwrite", "skip_existing": "ignore", "append": "append", "fail": "errorifexists"}


def export(df: DataFrame, path: str, form: str = "parquet", method: str = "fail", partition_by: list[str] | None = None) -> str:
    """Writes df; skip_existing leaves a path that exists alone. CSV goes out compressed, with the columns' metadata beside it."""
    writer = df.write.mode(MODES[method])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if form == "parquet":
        writer.parquet(path)
    elif form == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
        meta = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), str(dict(f.metadata))) for f in df.schema.fields], "name string, type string, metadata string")
        meta.coalesce(1).write.mode(MODES[method]).json(f"{path}_metadata")  # a row for each column
    else:
        raise ValueError("form is parquet or csv")
    return path


def csv_names(df: DataFrame) -> DataFrame:
    """Column names without spaces."""
    return df.withColumnsRenamed({c: c.replace(" ", "_") for c in df.columns})


def bundle(frames: dict[str, DataFrame], path: str, kind: str) -> str:
    """Results by output name under one root; the raw copy keeps `time`, the clean one drops it."""
    both = None
    for name, df in frames.items():
        df = df.withColumn("file_key", F.lit(expand_name(name)))
        both = df if both is None else both.unionByName(df, allowMissingColumns=True)
    both.write.mode("overwrite").partitionBy("file_key").option("header", True).csv(f"{path}/{kind}/raw")
    both.drop("time").write.mode("overwrite").partitionBy("file_key").option("header", True).csv(f"{path}/{kind}/clean")
    return path


def weather_file(df: DataFrame, path: str, station: str, lat: float, lon: float, columns: list[str], form: str = "epw") -> str:
    """One text file of a year's hours in order, with a location line first. A year has 8,760 rows, so one task writes it."""
    if form not in ("epw", "csv", "tmy"):
        raise ValueError("form is epw, csv or tmy")
    sep = {"epw": ",", "csv": ",", "tmy": "\t"}[form]
    lines = df.select(F.col("hour_of_year").alias("n"), F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))
    head = df.sparkSession.createDataFrame([(-2, f"LOCATION{sep}{station}{sep}{lat}{sep}{lon}"), (-1, sep.join(columns))], "n int, line string")
    head.unionByName(lines.withColumn("n", F.col("n").cast("int"))).coalesce(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)
    return path
