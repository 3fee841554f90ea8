"""What the corpus operators share: tables, folds, lineage cuts and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 64
_open: list[list[str]] = []  # what `cut` wrote within each `scratch` that is open


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, modulus: int):
    """crc32 of the id's decimal text modulo `modulus`; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every machine sees. Only a local session without the setting gets a folder of its own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="tephra-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, path: str) -> DataFrame:
    """df as files in path, and the frame that reads them."""
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tephra_path = path
    return out


def cut(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """Write df once to the shared folder and continue from the files, so lost executors cost no recomputation of it.

    The files of `instead`, an earlier cut that nothing reads any more, are deleted."""
    out = written(df, f"{shared_dir(df.sparkSession)}/tephra-{uuid.uuid4().hex}")
    if instead is not None:
        delete(df.sparkSession, instead._tephra_path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession, *more: str):
    """For work whose result is written within it: at its end the files of the cuts made in it are deleted, and the folders `more`."""
    _open.append([])
    try:
        yield
    finally:
        for path in [*_open.pop(), *more]:
            delete(spark, path)


def hot_keys(counts: DataFrame, key: str, total: int, n: str = "n") -> list:
    """The keys that hold over a thousandth of `total` rows, so fewer than a thousand; counts has a row for each key."""
    return [r[0] for r in counts.where(F.col(n) > max(256, total // 1000)).select(key).collect()]


def salt(key: Column, hot: list, spread: Column) -> Column:
    """For the side with many rows of a key: hot keys' rows are dealt to SALTS parts by `spread`."""
    return F.when(key.isin(hot), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)


def salts(key: Column, hot: list) -> Column:
    """For the side with few rows of a key: every part that the other side deals the key to, to be exploded."""
    return F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))


def join_hot(big: DataFrame, small: DataFrame, key: str, hot: list, spread: Column, how: str = "inner") -> DataFrame:
    """big joined with small by key, where no task gets all of big's rows of a hot key."""
    if not hot:
        return big.join(small, key, how)
    part = "salt of " + key
    many = big.withColumn(part, salt(F.col(key), hot, spread))
    return many.join(small.withColumn(part, F.explode(salts(F.col(key), hot))), [key, part], how).drop(part)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A string column as one binary array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary())


def slices(batch: pa.RecordBatch, column: str, max_rows: int, max_bytes: int):
    """Zero-copy pieces of a batch that hold at most max_rows rows and, beyond one row, max_bytes of text."""
    text = as_bytes(batch.column(column))
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    start = 0
    while start < len(text):
        end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        end = min(max(end, start + 1), start + max_rows, len(text))
        yield batch.slice(start, end - start), text.slice(start, end - start)
        start = end


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array in one buffer, and the offsets of its rows in it (nulls are empty)."""
    if text.null_count:
        text = text.fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
