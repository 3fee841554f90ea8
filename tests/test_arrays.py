import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.sources import arrays


def cube(spark):
    df = spark.range(7 * 5).select(F.expr("timestamp_ntz'2001-02-03 04:00:00' + make_dt_interval(0, int(id div 5))").alias("time"), (32 + id_() % 5 * 0.5).alias("lat"), F.when(id_() % 6 != 0, id_() * 1.5).alias("value"))
    return df


def id_():
    return F.col("id")


def rows(df):
    return sorted(tuple(r) for r in df.select("time", "lat", "value").where("value is not null").collect())


def test_zarr_round_trip_reads_only_chunks_within(spark, tmp_path):
    df, path = cube(spark), f"{tmp_path}/a"
    arrays.to_zarr(df, path, ["time", "lat"], chunks={"time": 3, "lat": 2}, attrs={"units": "K"})
    assert arrays.zarr_variables(path) == ["lat", "time", "value"]
    assert rows(arrays.zarr(spark, path, "value")) == rows(df)
    assert arrays.zarr(spark, path, "value").count() == 35
    (tmp_path / "a" / "value" / "0.0").write_bytes(b"spoilt")  # not read below
    got = arrays.zarr(spark, path, "value", within={"time": ("2001-02-03 07:00:00", "2001-02-03 09:00:00"), "lat": (32.5, 33.0)})
    assert rows(got) == rows(df.where("time between timestamp_ntz'2001-02-03 07:00:00' and timestamp_ntz'2001-02-03 09:00:00' and lat between 32.5 and 33.0"))
    assert arrays.zarr(spark, path, "value", within={"lat": (50, 60)}).count() == 0


def test_zarr_packed_numbers_missing_chunks_and_unknown_compressors(spark, tmp_path):
    own = tmp_path / "v"
    own.mkdir()
    meta = {"zarr_format": 2, "shape": [5], "chunks": [2], "dtype": "<i2", "compressor": None, "fill_value": -9, "order": "C", "filters": None, "dimension_separator": "/"}
    (own / ".zarray").write_text(json.dumps(meta))
    (own / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["x"], "scale_factor": 0.5, "add_offset": 1}))
    (own / "0").write_bytes(np.array([2, -9], "<i2").tobytes())
    (own / "2").write_bytes(np.array([4, 99], "<i2").tobytes())  # the second cell lies beyond the array
    got = [(r["x"], r["value"]) for r in arrays.zarr(spark, str(tmp_path), "v").orderBy("x").collect()]
    assert got == [(0, 2.0), (1, None), (2, None), (3, None), (4, 3.0)]
    (own / ".zarray").write_text(json.dumps(meta | {"compressor": {"id": "blosc"}}))
    with pytest.raises(ValueError):
        arrays.zarr(spark, str(tmp_path), "v")


def test_zarr_text_dimension_and_two_rows_of_a_cell(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0), ("bcd", 2, 3.0)], "sim string, n long, value double")
    arrays.to_zarr(df, f"{tmp_path}/s", ["sim", "n"])
    got = arrays.zarr(spark, f"{tmp_path}/s", "value").where("value is not null")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 2.0), ("bcd", 2, 3.0)]
    with pytest.raises(Exception, match="several rows"):
        arrays.to_zarr(df.union(df), f"{tmp_path}/t", ["sim", "n"])


def test_netcdf_round_trip_by_parts(spark, tmp_path):
    df, folder = cube(spark), f"{tmp_path}/n"
    arrays.to_netcdf(df, folder, ["time", "lat"], steps=3, attrs={"units": "K"})
    files = arrays.netcdf_files(folder)
    assert len(files) == 3
    assert rows(arrays.netcdf(spark, files, "value")) == rows(df)
    with pytest.raises(ValueError):
        arrays.netcdf(spark, files, "other")


def test_netcdf_records_by_hand(spark, tmp_path):
    """Two growing variables, the first of a padded size: a record holds 2 int16 and, after padding, one double."""
    import struct

    i = lambda n: struct.pack(">i", n)
    name = lambda s: i(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    units = i(12) + i(1) + name("units") + i(2) + name("days since 2000-01-01")

    def head(begins):
        first = name("v") + i(2) + i(0) + i(1) + i(0) + i(0) + i(3) + i(8) + i(begins[0])
        second = name("time") + i(1) + i(0) + units + i(6) + i(8) + i(begins[1])
        return b"CDF\x01" + i(2) + i(10) + i(2) + name("time") + i(0) + name("x") + i(3) + i(0) + i(0) + i(11) + i(2) + first + second

    start = len(head([0, 0]))
    data = b"".join(struct.pack(">hhhxxd", *r) for r in ((1, 2, 3, 0.0), (4, 5, 6, 1.5)))
    (tmp_path / "r.nc").write_bytes(head([start, start + 8]) + data)
    got = [(str(r["time"]), r["x"], r["value"]) for r in arrays.netcdf(spark, f"{tmp_path}/r.nc", "v").orderBy("time", "x").collect()]
    assert got == [("2000-01-01 00:00:00", x, x + 1.0) for x in range(3)] + [("2000-01-02 12:00:00", x, x + 4.0) for x in range(3)]
