"""Streaming forms of resampling, rolling reductions, runs and counts over an event stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, folder: str, schema, files: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def resample(df: DataFrame, keys: list[str], period: str = "1 day", late: str = "1 hour", time: str = "ts", value: str = "value") -> DataFrame:
    """Tumbling windows; rows later than the watermark are dropped."""
    got = df.withWatermark(time, late).groupBy(F.window(time, period).alias("w"), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("min"), F.max(value).alias("max"))
    return got.select(F.col("w.start").alias("start"), *keys, "n", "total", "min", "max")


def rolling(df: DataFrame, keys: list[str], length: str = "3 days", step: str = "1 day", late: str = "1 hour", time: str = "ts", value: str = "value", needed: int = 0) -> DataFrame:
    """Sliding windows; those with fewer than `needed` values are left out."""
    got = df.withWatermark(time, late).groupBy(F.window(time, length, step).alias("w"), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    return got.where(F.col("n") >= needed).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    got = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def exceedances(df: DataFrame, keys: list[str], threshold: float, value: str = "value") -> DataFrame:
    """Running counts by key, for update or complete mode."""
    return df.groupBy(*keys).agg(F.count_if(F.col(value) > threshold).alias("hits"), F.count("*").alias("n"))


def _by_state(df: DataFrame, key: str, columns: str, state: str, first, step) -> DataFrame:
    """Grouped state over a key's rows in order of time, then value. A row that is not after the last one seen in earlier batches is late and dropped.

    step takes (state, time, value) and gives the next state and the rows that are now settled; state's first field is the last time seen."""

    def run(k, batches, held: GroupState):
        now, out = held.get if held.exists else first, []
        seen = now[0]
        rows = pd.concat(list(batches)).sort_values(["ts", "value"])
        for t, v in zip(rows["ts"], rows["value"], strict=True):
            if seen is None or t > seen:
                now, done = step(now, t, v)
                out += [(*k, *d) for d in done]
        held.update(now)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")])

    return df.groupBy(key).applyInPandasWithState(run, columns, state, "append", GroupStateTimeout.NoTimeout)


def running_extremes(df: DataFrame, key: str, n: int, threshold: float, value: str = "value", time: str = "ts") -> DataFrame:
    """Emits (key, start, end, length) for each run of n or more values in a row above threshold, once the run has ended; the open run is kept in state.

    A null ends a run. Rows of a key that come in a later micro-batch than a row of later time are dropped."""
    kinds = dict(df.dtypes)
    stamp = kinds[time]

    def step(now, t, v):
        _, start, end, length = now
        if v is not None and v > threshold:
            return (t, t if length == 0 else start, t, length + 1), []
        return (t, None, None, 0), [(start, end, length)] if length >= n else []

    rows = df.select(key, F.col(time).alias("ts"), F.col(value).alias("value"))
    return _by_state(rows, key, f"{key} {kinds[key]}, start {stamp}, end {stamp}, length long", f"seen {stamp}, start {stamp}, last {stamp}, length long", (None, None, None, 0), step)


def running_starts(df: DataFrame, key: str, n: int, threshold: float, value: str = "value", time: str = "ts") -> DataFrame:
    """Emits (key, start) for each row that begins n values in a row above threshold, as soon as the n-th has come; state holds at most n - 1 times.

    The streaming form of a forward duration: a start whose n-th row hasn't come is not emitted. Nulls and late rows as in running_extremes."""
    kinds = dict(df.dtypes)
    stamp = kinds[time]

    def step(now, t, v):
        if v is None or not v > threshold:
            return (t, []), []
        times = [*now[1], t]
        return ((t, times[1:]), [(times[0],)]) if len(times) == n else ((t, times), [])

    rows = df.select(key, F.col(time).alias("ts"), F.col(value).alias("value"))
    return _by_state(rows, key, f"{key} {kinds[key]}, start {stamp}", f"seen {stamp}, times array<{stamp}>", (None, []), step)


def replay(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end into a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def append(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream to the end of what its source has now, writing rows as they are final to Parquet files in `path`, and reads them.

    Nothing is held on the driver; windows still open at the watermark stay in the checkpoint beside it, so a later call goes on from there."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
