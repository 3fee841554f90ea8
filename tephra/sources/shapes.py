"""Boundary files as rings for `operators.geo`: shapefiles, plain or zipped, and geometry columns of well-known binary as GeoParquet has them.

Coordinates are taken as they are; `geo.lambert` and `geo.mercator` project. A file is read by one task (the formats hold 2 GB at most)."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import _put

RING = "array<struct<lon: double, lat: double>>"
_ring = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
_schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("part", pa.int32()), ("ring", _ring), ("attributes", pa.map_(pa.string(), pa.string()))])


def shapefile(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, record, part, ring, attributes) of .shp files with their .dbf beside them, of .zip files with such pairs, or of folders of either.

    A ring's closing point is left out. Null shapes and deleted records have no row; points are rings of one point; attributes are trimmed texts."""
    wanted = [p[:-4] + ".{shp,dbf}" if p.endswith(".shp") else p for p in paths]
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf,zip}").load(wanted).select(F.regexp_extract("path", r"^(.*)\.(\w+)$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "content")
    files = found.groupBy("stem").agg(*[F.first(F.when(F.col("kind") == k, F.col("content")), ignorenulls=True).alias(k) for k in ("shp", "dbf", "zip")])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pairs = [(row["stem"], row["shp"], row["dbf"])] if row["shp"] else []
                for stem, shp, dbf in pairs + (list(_members(row["zip"])) if row["zip"] else []):
                    got = list(_polygons(stem.rsplit("/", 1)[-1], shp, dbf))
                    for at in range(0, len(got), 256):
                        yield pa.RecordBatch.from_pylist(got[at : at + 256], _schema)

    return files.mapInArrow(run, f"file string, record long, part int, ring {RING}, attributes map<string, string>")


def _members(data: bytes) -> Iterator[tuple[str, bytes, bytes | None]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {n.lower(): n for n in z.namelist()}
        for low, name in names.items():
            if low.endswith(".shp"):
                table = names.get(low[:-4] + ".dbf")
                yield name[:-4], z.read(name), z.read(table) if table else None


def _polygons(file: str, shp: bytes, dbf: bytes | None) -> Iterator[dict]:
    if struct.unpack_from(">i", shp)[0] != 9994:
        raise ValueError(f"{file} is no shapefile")
    table, at, record = _attributes(dbf) if dbf else None, 100, 0
    while at + 8 <= len(shp):
        words = struct.unpack_from(">i", shp, at + 4)[0]
        own = table[record] if table is not None and record < len(table) else {}
        if own is not None:
            for part, ring in enumerate(_parts(shp, at + 8)):
                points = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
                yield {"file": file, "record": record, "part": part, "ring": [{"lon": x, "lat": y} for x, y in points.tolist()], "attributes": list(own.items())}
        at += 8 + 2 * words
        record += 1


def _parts(shp: bytes, at: int) -> list[np.ndarray]:
    """The points of each part; heights and measures are not read."""
    kind = struct.unpack_from("<i", shp, at)[0]
    if kind == 0:
        return []
    if kind in (1, 11, 21):
        return [np.frombuffer(shp, "<f8", 2, at + 4).reshape(1, 2)]
    if kind not in (3, 5, 13, 15, 23, 25):
        raise ValueError(f"shapes of kind {kind} are not read; points, lines and polygons are")
    parts, points = struct.unpack_from("<ii", shp, at + 36)
    starts = [*np.frombuffer(shp, "<i4", parts, at + 44).tolist(), points]
    xy = np.frombuffer(shp, "<f8", 2 * points, at + 44 + 4 * parts).reshape(-1, 2)
    return [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def _attributes(dbf: bytes) -> list[dict | None]:
    """A dictionary for each record, None for a deleted one. Texts are UTF-8, or else Latin-1; empty ones are null."""
    count, start, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), dbf[at + 16]))
        at += 32

    def text(raw: bytes) -> str | None:
        try:
            out = raw.decode()
        except UnicodeDecodeError:
            out = raw.decode("latin-1")
        return out.strip(" \0") or None

    rows = []
    for i in range(count):
        at, own = start + i * width + 1, {}
        for name, size in fields:
            own[name] = text(dbf[at : at + size])
            at += size
        rows.append(None if dbf[start + i * width : start + i * width + 1] == b"*" else own)
    return rows


def to_shapefile(polygons: DataFrame, path: str, key: str = "region_id", ring: str = "ring") -> str:
    """Writes a zipped shapefile of polygons, a record for each key with all of its rings, the key its attribute. One file, so one task writes it."""
    rows = polygons.groupBy(F.col(key).cast("string").alias("key")).agg(F.array_sort(F.collect_list(F.struct("part" if "part" in polygons.columns else F.lit(0).alias("part"), F.col(ring).alias("ring")))).alias("parts"))
    rows = rows.unionByName(polygons.sparkSession.range(1).select(), allowMissingColumns=True)  # a row without parts, so that an empty table gives a file too

    def run(batches):
        shapes = sorted(((r["key"] or "", [[(p["lon"], p["lat"]) for p in one["ring"]] for one in r["parts"]]) for b in batches for r in b.to_pylist() if r["parts"] is not None), key=lambda s: s[0])
        _put(path, _packed(path.rsplit("/", 1)[-1].removesuffix(".zip"), key, shapes))
        yield pa.RecordBatch.from_pylist([{"records": len(shapes)}], pa.schema([("records", pa.int64())]))

    rows.coalesce(1).mapInArrow(run, "records long").count()
    return path


def _packed(name: str, key: str, shapes: list) -> bytes:
    body, edges = b"", []
    for i, (_, rings) in enumerate(shapes):
        rings = [np.array([*r, r[0]] if r[0] != r[-1] else r, "<f8") for r in rings if r]
        xy = np.concatenate(rings) if rings else np.zeros((0, 2))
        if len(xy):
            box = [*xy.min(0), *xy.max(0)]
            edges.append(box)
            starts = np.cumsum([0, *map(len, rings)])[:-1].astype("<i4")
            content = struct.pack("<i4dii", 5, *box, len(rings), len(xy)) + starts.tobytes() + xy.tobytes()
        else:
            content = struct.pack("<i", 0)
        body += struct.pack(">ii", i + 1, len(content) // 2) + content
    low, high = (np.min(edges, 0)[:2], np.max(edges, 0)[2:]) if edges else (np.zeros(2), np.zeros(2))
    shp = struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *low, *high, 0, 0, 0, 0) + body
    texts = [k.encode() for k, _ in shapes]
    if max(map(len, texts), default=0) > 254:
        raise ValueError("an attribute holds 254 bytes at most")
    width = max(1, *map(len, texts), 1)
    dbf = struct.pack("<B3xIHH20x", 3, len(texts), 65, width + 1) + struct.pack("<11sc4xB15x", key.encode()[:10], b"C", width) + b"\r" + b"".join(b" " + t.ljust(width) for t in texts) + b"\x1a"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{name}.shp", shp)
        z.writestr(f"{name}.dbf", dbf)
    return out.getvalue()


def rings_from_wkb(df: DataFrame, wkb: str = "geometry", key: str = "region_id") -> DataFrame:
    """(key, part, ring) of a column of well-known binary polygons and multipolygons, with or without heights; a null has no row, other kinds raise."""

    @F.pandas_udf(f"array<{RING}>")
    def parsed(column):
        return column.map(lambda b: None if b is None else [[{"lon": x, "lat": y} for x, y in (r[:-1] if len(r) > 1 and r[0] == r[-1] else r)] for r in _wkb(bytes(b), 0)[0]])

    return df.select(key, F.posexplode(parsed(wkb)).alias("part", "ring"))


def _wkb(data: bytes, at: int) -> tuple[list, int]:
    """The rings of the geometry that begins at `at`, and where it ends."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    flags, code = code >> 28, code & 0x0FFFFFFF
    at += 9 if flags & 2 else 5  # a reference system's number may follow
    dims = 2 + (code // 1000 in (1, 3)) + (code // 1000 in (2, 3)) + bool(flags & 8) + bool(flags & 4)
    n = struct.unpack_from(order + "I", data, at)[0]
    at, rings = at + 4, []
    if code % 1000 == 3:
        for _ in range(n):
            points = struct.unpack_from(order + "I", data, at)[0]
            xy = np.frombuffer(data, order + "f8", points * dims, at + 4).reshape(points, dims)[:, :2]
            rings.append([tuple(p) for p in xy.tolist()])
            at += 4 + 8 * points * dims
    elif code % 1000 == 6:
        for _ in range(n):
            own, at = _wkb(data, at)
            rings += own
    else:
        raise ValueError(f"geometries of kind {code % 1000} are not read; polygons and multipolygons are")
    return rings, at


def wkb_of(rings: Column) -> Column:
    """Well-known binary of an array of rings, each its own polygon of a multipolygon."""

    @F.pandas_udf("binary")
    def packed(column):
        def one(shape):
            out = struct.pack("<BII", 1, 6, len(shape))
            for r in shape:
                xy = [(p["lon"], p["lat"]) for p in r]
                xy = np.array(xy if not xy or xy[0] == xy[-1] else [*xy, xy[0]], "<f8")
                out += struct.pack("<BIII", 1, 3, 1, len(xy)) + xy.tobytes()
            return out

        return column.map(lambda s: None if s is None else one(s))

    return packed(rings)


def named(boundaries: DataFrame, kind: str, names: list[str] | None = None, geoids: list[str] | None = None) -> DataFrame:
    """Of a boundary table (kind, name, geoid, ...) the boundaries of a kind, by names in any case or by ids; all of the kind without either."""
    out = boundaries.where(F.col("kind") == kind)
    if names is not None:
        out = out.where(F.lower("name").isin([n.lower() for n in names]))
    return out if geoids is None else out.where(F.col("geoid").isin(geoids))
