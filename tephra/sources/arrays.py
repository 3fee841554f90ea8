"""Gridded arrays as long tables with a row for each cell: Zarr (version 2) folders and classic NetCDF files, read and written by chunks.

The driver reads metadata and the coordinates along each dimension; tasks read and write chunks, so memory goes with a chunk. A dimension without a
coordinate variable is its index from 0. Numbers "<unit> since <date>" of a standard calendar become timestamps, those of other calendars stay numbers.
Cells that hold the fill value, the missing value or NaN are NULL; so are chunks that were never written. Compression: none, zlib, gzip, bz2, lzma, zstd.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells in a slab of a NetCDF variable, which has no chunks of its own, and rows in a batch.
SLAB, BATCH = 1 << 20, 1 << 16
#: Fixed values of the NetCDF classic format: types by number, tags of its lists, and the default fill of doubles.
NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
NC_DIMENSION, NC_VARIABLE, NC_ATTRIBUTE = 10, 11, 12
NC_FILL = 9.969209968386869e36
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
STANDARD = ("standard", "gregorian", "proleptic_gregorian")
EPOCH = "seconds since 1970-01-01 00:00:00"


@dataclass(frozen=True)
class Array:
    """One variable of one store: `load` gives the cells of a chunk by its place in the grid of chunks, or None for a chunk that isn't there."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    attrs: dict
    load: Callable[[tuple[int, ...]], np.ndarray | None]
    coords: dict[str, np.ndarray] = field(default_factory=dict)

    def values(self, at: tuple[int, ...]) -> np.ndarray:
        size = [min(c, n - i * c) for i, c, n in zip(at, self.chunks, self.shape, strict=True)]
        got = self.load(at)
        if got is None:
            return np.full(size, np.nan)
        got = got[tuple(slice(0, n) for n in size)]
        return got if got.dtype.kind in "USO" else _unpacked(got, self.attrs)

    def whole(self) -> np.ndarray:
        """The coordinate along a dimension."""
        parts = [self.values((i,)) for i in range(-(-self.shape[0] // self.chunks[0]))]
        return _times(np.concatenate(parts) if parts else np.empty(0), self.attrs)


def _unpacked(cells: np.ndarray, attrs: dict) -> np.ndarray:
    out = cells.astype(float)
    for name in ("_FillValue", "missing_value"):
        if isinstance(attrs.get(name), (int, float)):
            out[cells == np.asarray(attrs[name]).astype(cells.dtype)] = np.nan
    return out * attrs.get("scale_factor", 1.0) + attrs.get("add_offset", 0.0)


def _times(numbers: np.ndarray, attrs: dict) -> np.ndarray:
    unit, _, since = str(attrs.get("units", "")).partition(" since ")
    step = SECONDS.get(unit.strip().lower().rstrip("s"))
    if not since or step is None or attrs.get("calendar", "standard") not in STANDARD:
        return numbers
    start = datetime.fromisoformat(since.strip().removesuffix("UTC").removesuffix("Z").strip())
    return np.datetime64(start, "us") + np.round(numbers * step * 1e6).astype("timedelta64[us]")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _get(path: str) -> bytes | None:
    where, inner = _open(path)
    if where.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    with where.open_input_stream(inner) as f:
        return f.read()


def _put(path: str, data: bytes) -> None:
    """Writes under another name first, so that no task leaves half a file."""
    where, inner = _open(path)
    where.create_dir(inner.rpartition("/")[0], recursive=True)
    name = f"{inner}.{uuid.uuid4().hex}"
    with where.open_output_stream(name) as f:
        f.write(data)
    where.move(name, inner)


def _json(path: str) -> dict | None:
    data = _get(path)
    return None if data is None else json.loads(data)


# Zarr ------------------------------------------------------------------------------------------------------------------------------------------------


def _unzipped(data: bytes, codec: dict | None) -> bytes:
    kind = (codec or {}).get("id")
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    plain = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress}
    return plain[kind](data)


def _zarr_array(path: str, name: str) -> Array | None:
    meta = _json(f"{path}/{name}/.zarray")
    if meta is None:
        return None
    attrs = _json(f"{path}/{name}/.zattrs") or {}
    codec, fill = meta["compressor"], meta["fill_value"]
    if meta.get("filters") or (codec or {}).get("id") not in (None, "zlib", "gzip", "bz2", "lzma", "zstd"):
        raise ValueError(f"{path}/{name}: no reader for its filters or for its compressor")
    dims = tuple(attrs.get("_ARRAY_DIMENSIONS") or [f"dim_{i}" for i in range(len(meta["shape"]))])
    if isinstance(fill, (int, float)):
        attrs.setdefault("_FillValue", fill)
    kind, order, chunks, mark = np.dtype(meta["dtype"]), meta["order"], tuple(meta["chunks"]), meta.get("dimension_separator", ".")

    def load(at):
        data = _get(f"{path}/{name}/{mark.join(map(str, at)) or '0'}")
        return None if data is None else np.frombuffer(_unzipped(data, codec), kind).reshape(chunks, order=order)

    return Array(dims, tuple(meta["shape"]), chunks, attrs, load)


def zarr_variables(path: str) -> list[str]:
    """The arrays of a store, by name."""
    where, inner = _open(path)
    return sorted(f.base_name for f in where.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.Directory and _get(f"{path}/{f.base_name}/.zarray") is not None)


def zarr(spark: SparkSession, paths: str | list[str], variable: str, within: dict | None = None) -> DataFrame:
    """One variable of one or several stores of the same dimensions: (a column for each dimension, value). `within` {dimension: (least, largest)} limits the
    chunks that are read, and the rows."""
    return _scan(spark, paths, variable, _zarr_array, within)


# NetCDF ----------------------------------------------------------------------------------------------------------------------------------------------


def _header(path: str) -> tuple[dict, dict, int]:
    """Dimensions {name: length}, variables {name: (dims, type, attrs, begin, whether it grows)}, and bytes of a record of all growing variables."""
    where, inner = _open(path)
    with where.open_input_stream(inner, buffer_size=1 << 16) as f:
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"{path}: not a classic NetCDF file")
        wide, far = magic[3] == 5, magic[3] != 1
        count = lambda: struct.unpack(">q" if wide else ">i", f.read(8 if wide else 4))[0]
        number = lambda: struct.unpack(">i", f.read(4))[0]

        def text() -> str:
            n = count()
            return f.read(n + -n % 4)[:n].decode()

        def listed(one) -> list:
            number()
            return [one() for _ in range(count())]

        def attribute():
            name, kind, n = text(), NC_TYPES[number()], count()
            size = n * np.dtype(kind).itemsize
            data = f.read(size + -size % 4)[:size]
            cells = np.frombuffer(data, kind)
            return name, data.decode(errors="replace") if kind == "S1" else cells[0].item() if n == 1 else cells.tolist()

        records = count()
        dims = listed(lambda: (text(), count()))

        def variable():
            name, ids = text(), [count() for _ in range(count())]
            attrs, kind = dict(listed(attribute)), NC_TYPES[number()]
            count()  # the stated size, which overflows for large variables
            begin = struct.unpack(">q" if far else ">i", f.read(8 if far else 4))[0]
            return name, (tuple(dims[i][0] for i in ids), np.dtype(kind), attrs, begin, bool(ids) and dims[ids[0]][1] == 0)

        listed(attribute)
        variables = dict(listed(variable))
    lengths = {name: n or records for name, n in dims}
    sizes = [int(np.prod([lengths[d] for d in v[0][1:]], dtype=np.int64)) * v[1].itemsize for v in variables.values() if v[4]]
    return lengths, variables, sizes[0] if len(sizes) == 1 else sum(s + -s % 4 for s in sizes)


def _netcdf_array(path: str, name: str) -> Array | None:
    lengths, variables, record = _header(path)
    if name not in variables:
        return None
    dims, kind, attrs, begin, grows = variables[name]
    shape = tuple(lengths[d] for d in dims)
    row = int(np.prod(shape[1:], dtype=np.int64))
    step = record if grows else row * kind.itemsize
    chunks = (max(1, min(shape[0], SLAB // max(1, row))), *shape[1:]) if dims else ()

    def load(at):
        first = at[0] * chunks[0] if at else 0
        rows = min(chunks[0], shape[0] - first) if at else 1
        where, inner = _open(path)
        with where.open_input_file(inner) as f:
            if not grows:
                f.seek(begin + first * step)
                return np.frombuffer(f.read(rows * step), kind).reshape((rows, *shape[1:]) if at else ())
            parts = []
            for i in range(first, first + rows):
                f.seek(begin + i * step)
                parts.append(np.frombuffer(f.read(row * kind.itemsize), kind))
            return np.concatenate(parts).reshape(rows, *shape[1:])

    return Array(dims, shape, chunks, attrs, load)


def netcdf(spark: SparkSession, paths: str | list[str], variable: str, within: dict | None = None) -> DataFrame:
    """As `zarr`, from classic NetCDF files (versions 1, 2 and 5); the first dimension is cut into slabs of some SLAB cells."""
    return _scan(spark, paths, variable, _netcdf_array, within)


# Both ------------------------------------------------------------------------------------------------------------------------------------------------


def _scan(spark: SparkSession, paths: str | list[str], variable: str, reader, within: dict | None) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)

    def opened(path: str) -> Array:
        array = reader(path, variable)
        if array is None:
            raise ValueError(f"{path} has no variable {variable}")
        for dim, n in zip(array.dims, array.shape, strict=True):
            own = reader(path, dim)
            array.coords[dim] = own.whole() if own and own.dims == (dim,) else np.arange(n)
        return array

    with ThreadPoolExecutor(16) as pool:
        arrays = list(pool.map(opened, paths))
    grids = [_grid(a, within or {}) for a in arrays]
    ends = np.cumsum([int(np.prod(counts, dtype=np.int64)) for _, counts in grids])
    kinds = {d: _arrow_type(arrays[0].coords[d]) for d in arrays[0].dims}
    schema = pa.schema([*kinds.items(), ("value", pa.float64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                n = int(np.searchsorted(ends, i, side="right"))
                low, counts = grids[n]
                place = np.unravel_index(i - (int(ends[n - 1]) if n else 0), counts) if counts else ()
                yield from _rows(arrays[n], tuple(int(a + b) for a, b in zip(low, place, strict=True)), schema)

    total = int(ends[-1])
    tasks = max(1, min(total, 1 << 16))
    out = spark.range(0, total, 1, tasks).mapInArrow(read, ", ".join(f"`{n}` {_spark_type(t)}" for n, t in zip(schema.names, schema.types, strict=True)))
    for dim, (least, largest) in (within or {}).items():
        out = out.where(F.col(dim).between(F.lit(least), F.lit(largest)))
    return out


def _grid(array: Array, within: dict) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The first chunk and the number of chunks along each dimension that can hold cells within the limits."""
    low, counts = [], []
    for dim, chunk in zip(array.dims, array.chunks, strict=True):
        at = array.coords[dim]
        if dim in within:
            least, largest = (np.datetime64(v, "us") if at.dtype.kind == "M" else v for v in within[dim])
            hits = np.flatnonzero((at >= least) & (at <= largest))
        else:
            hits = np.arange(len(at))
        low.append(int(hits.min()) // chunk if len(hits) else 0)
        counts.append(int(hits.max()) // chunk - low[-1] + 1 if len(hits) else 0)
    return tuple(low), tuple(counts)


def _rows(array: Array, at: tuple[int, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    block = np.asarray(array.values(at))
    flat = block.reshape(-1)
    for first in range(0, flat.size, BATCH):
        last = min(flat.size, first + BATCH)
        place = np.unravel_index(np.arange(first, last), block.shape) if block.shape else ()
        cols = [array.coords[d][p + i * c] for d, p, i, c in zip(array.dims, place, at, array.chunks, strict=True)]
        cols = [pa.array(c.tolist() if c.dtype.kind == "U" else c).cast(t) for c, t in zip(cols, schema.types, strict=False)]
        yield pa.record_batch([*cols, pa.array(flat[first:last], pa.float64(), from_pandas=True)], schema=schema)


def _arrow_type(coord: np.ndarray) -> pa.DataType:
    return {"M": pa.timestamp("us"), "U": pa.string(), "f": pa.float64()}.get(coord.dtype.kind, pa.int64())


def _spark_type(kind: pa.DataType) -> str:
    return {pa.timestamp("us"): "timestamp_ntz", pa.string(): "string", pa.float64(): "double"}.get(kind, "long")


def _blocks(df: DataFrame, dims: list[str], value: str, chunks: dict[str, int], put: Callable[[tuple[int, ...], np.ndarray], None]) -> dict[str, np.ndarray]:
    """Hands each chunk's cells to `put` in the tasks; the coordinates along the dimensions, sorted. Cells without a row are NaN; two rows of one cell are an error."""
    spark, coords, cells = df.sparkSession, {}, df.select(*dims, F.col(value).cast("double").alias("__value"))
    for dim in dims:
        kind = dict(df.dtypes)[dim]
        own = cells.select(dim).distinct().where(F.col(dim).isNotNull())
        if kind in ("date", "timestamp", "timestamp_ntz"):
            cells, own = (x.withColumn(dim, F.col(dim).cast("timestamp_ntz")) for x in (cells, own))
        coords[dim] = np.sort(own.toPandas()[dim].to_numpy())
        places = own.sparkSession.createDataFrame([], f"`{dim}` {dict(own.dtypes)[dim]}, `__{dim}` long")
        if len(coords[dim]):
            listed = coords[dim].astype("datetime64[us]").tolist() if coords[dim].dtype.kind == "M" else coords[dim].tolist()
            places = spark.createDataFrame(list(zip(listed, range(len(listed)), strict=True)), places.schema)
        cells = cells.join(places, dim)  # as long as the dimension, so left to the planner
    shape = [min(chunks.get(d, len(coords[d])), len(coords[d])) or 1 for d in dims]
    block = [F.floor(F.col(f"__{d}") / n).alias(f"__at_{d}") for d, n in zip(dims, shape, strict=True)]

    def write(pdf):
        at = tuple(int(pdf[f"__at_{d}"].iloc[0]) for d in dims)
        place = tuple(pdf[f"__{d}"].to_numpy() - i * n for d, i, n in zip(dims, at, shape, strict=True))
        if len(np.unique(np.ravel_multi_index(place, shape))) < len(pdf):
            raise ValueError(f"several rows for one cell of chunk {at}")
        out = np.full(shape, np.nan)
        out[place] = pdf["__value"].to_numpy(float)
        put(at, out)
        return pdf.iloc[:1][["__at_" + dims[0]]]

    cells = cells.select(*[f"__{d}" for d in dims], *block, "__value")
    cells.groupBy(*[f"__at_{d}" for d in dims]).applyInPandas(write, f"`__at_{dims[0]}` long").agg(F.count("*")).first()
    return coords


def _numbers(coord: np.ndarray) -> tuple[np.ndarray, dict]:
    if coord.dtype.kind == "M":
        return (coord.astype("datetime64[us]") - np.datetime64(0, "us")) / np.timedelta64(1, "s"), {"units": EPOCH, "calendar": "standard"}
    return (coord.astype("U") if coord.dtype.kind == "O" else coord), {}


def to_zarr(df: DataFrame, path: str, dims: list[str], value: str = "value", chunks: dict[str, int] | None = None, attrs: dict | None = None) -> str:
    """Writes a store of one variable, a file for each chunk, compressed by zlib. The metadata comes last: a store without it isn't whole."""

    def put(at, cells):
        _put(f"{path}/{value}/{'.'.join(map(str, at))}", zlib.compress(cells.astype("<f8").tobytes(), 1))

    coords = _blocks(df, dims, value, chunks or {}, put)

    def meta(name, shape, parts, kind, own):
        about = {"zarr_format": 2, "shape": shape, "chunks": parts, "dtype": kind, "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN" if kind == "<f8" else None, "order": "C", "filters": None}
        _put(f"{path}/{name}/.zattrs", json.dumps(own).encode())
        _put(f"{path}/{name}/.zarray", json.dumps(about).encode())

    for dim in dims:
        cells, own = _numbers(coords[dim])
        cells = np.asarray(cells).astype(np.asarray(cells).dtype.newbyteorder("<"))
        if len(cells):
            _put(f"{path}/{dim}/0", zlib.compress(cells.tobytes(), 1))
        meta(dim, [len(cells)], [max(1, len(cells))], cells.dtype.str, {**own, "_ARRAY_DIMENSIONS": [dim]})
    shape = [len(coords[d]) for d in dims]
    meta(value, shape, [min((chunks or {}).get(d, n), n) or 1 for d, n in zip(dims, shape, strict=True)], "<f8", {**(attrs or {}), "_ARRAY_DIMENSIONS": dims})
    _put(f"{path}/.zgroup", b'{"zarr_format": 2}')
    return path


def to_netcdf(df: DataFrame, folder: str, dims: list[str], value: str = "value", steps: int = 1024, attrs: dict | None = None) -> str:
    """Writes one classic file (64-bit offsets, doubles) for each `steps` coordinates of the first dimension: part-<number>.nc. Dimensions are numbers or times."""
    for d in dims:
        if dict(df.dtypes)[d] == "string":
            raise ValueError("a dimension of text has no place in a classic file; write a folder for each text")
    coords = {d: np.sort(df.select(F.col(d).cast("timestamp_ntz").alias(d) if dict(df.dtypes)[d] in ("date", "timestamp") else d).distinct().dropna().toPandas()[d].to_numpy()) for d in dims}

    def put(at, cells):
        first = at[0] * steps
        own = {**coords, dims[0]: coords[dims[0]][first : first + steps]}
        _put(f"{folder}/part-{at[0]:06d}.nc", _classic(own, dims, value, cells[: len(own[dims[0]])], attrs or {}))

    _blocks(df, dims, value, {dims[0]: steps}, put)
    return folder


def netcdf_files(folder: str) -> list[str]:
    where, inner = _open(folder)
    return [f"{folder}/{f.base_name}" for f in sorted(where.get_file_info(fs.FileSelector(inner)), key=lambda f: f.base_name) if f.base_name.endswith(".nc")]


def _classic(coords: dict[str, np.ndarray], dims: list[str], name: str, cells: np.ndarray, attrs: dict) -> bytes:
    i4 = lambda n: struct.pack(">i", n)

    def text(s: str) -> bytes:
        b = s.encode()
        return i4(len(b)) + b + b"\0" * (-len(b) % 4)

    def listed(tag: int, items: list[bytes]) -> bytes:
        return i4(tag if items else 0) + i4(len(items)) + b"".join(items)

    def attribute(key: str, v) -> bytes:
        return text(key) + (i4(6) + i4(1) + struct.pack(">d", v) if isinstance(v, (int, float)) else i4(2) + text(str(v)))

    parts = [(d, [i], *_numbers(coords[d])) for i, d in enumerate(dims)]
    parts.append((name, list(range(len(dims))), np.where(np.isnan(cells), NC_FILL, cells), {**attrs, "_FillValue": NC_FILL}))
    datas = [np.asarray(c).astype(">f8").tobytes() for _, _, c, _ in parts]

    def head(begins: list[int]) -> bytes:
        variables = [
            text(n) + i4(len(ids)) + b"".join(map(i4, ids)) + listed(NC_ATTRIBUTE, [attribute(k, v) for k, v in own.items()]) + i4(6) + struct.pack(">I", min(len(data), 2**32 - 1)) + struct.pack(">q", b)
            for (n, ids, _, own), data, b in zip(parts, datas, begins, strict=True)
        ]
        return b"CDF\x02" + i4(0) + listed(NC_DIMENSION, [text(d) + i4(len(coords[d])) for d in dims]) + listed(NC_ATTRIBUTE, []) + listed(NC_VARIABLE, variables)

    start = len(head([0] * len(parts)))
    begins = [start + sum(map(len, datas[:i])) for i in range(len(parts))]
    return head(begins) + b"".join(datas)
