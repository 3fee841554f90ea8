import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tephra.operators import geo, subset
from tephra.sources import catalog, scan, shapes

SQUARE = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
HOLE = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]


def shp(*records: bytes) -> bytes:
    body = b"".join(struct.pack(">ii", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    return struct.pack(">iiiiiii", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + body


def polygon(*rings, kind=5) -> bytes:
    starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
    n = sum(map(len, rings))
    heights = struct.pack(f"<2d{n}d", 0, 9, *[9.0] * n) if kind == 15 else b""
    return struct.pack("<i4d2i", kind, 0, 0, 2, 2, len(rings), n) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for r in rings for p in r) + heights


def dbf(*rows: tuple[bytes, bytes]) -> bytes:
    fields = struct.pack("<11sc4xB15x", b"NAME", b"C", 8) + struct.pack("<11sc4xB15x", b"POP", b"N", 4)
    return struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 32 + 64 + 1, 13) + fields + b"\r" + b"".join(flag + name.ljust(8) + b"  42" for flag, name in rows) + b"\x1a"


def told(df):
    return sorted((r["file"], r["record"], r["part"], [tuple(p) for p in r["ring"]], r["attributes"]) for r in df.collect())


def test_shapefiles_plain_and_zipped(spark, tmp_path):
    shapes_of = shp(polygon(SQUARE, HOLE), struct.pack("<i", 0), polygon(SQUARE, kind=15), polygon(HOLE))
    table = dbf((b" ", b"north"), (b" ", b"none"), (b" ", "Niño".encode("latin-1")), (b"*", b"gone"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.shp").write_bytes(shapes_of)
    (tmp_path / "in" / "a.dbf").write_bytes(table)
    (tmp_path / "in" / "bare.shp").write_bytes(shp(polygon(HOLE)))
    with zipfile.ZipFile(tmp_path / "in" / "z.zip", "w") as z:
        z.writestr("deep/B.SHP", shapes_of)
        z.writestr("deep/B.dbf", table)
    north, nino = {"NAME": "north", "POP": "42"}, {"NAME": "Niño", "POP": "42"}
    a = [("a", 0, 0, SQUARE[:-1], north), ("a", 0, 1, HOLE[:-1], north), ("a", 2, 0, SQUARE[:-1], nino)]
    bare = [("bare", 0, 0, HOLE[:-1], {})]
    assert told(shapes.shapefile(spark, str(tmp_path / "in"))) == sorted(a + bare + [("B", *r[1:]) for r in a])
    assert told(shapes.shapefile(spark, str(tmp_path / "in" / "a.shp"))) == a
    assert told(shapes.shapefile(spark, str(tmp_path / "in" / "bare.shp"))) == bare
    (tmp_path / "bad.shp").write_bytes(b"\0" * 200)
    with pytest.raises(Exception, match="no shapefile"):
        shapes.shapefile(spark, str(tmp_path / "bad.shp")).collect()


def test_written_shapefile_comes_back(spark, tmp_path):
    ring = lambda points: [{"lon": x, "lat": y} for x, y in points[:-1]]
    rows = spark.createDataFrame([("b", 1, ring(HOLE)), ("b", 0, ring(SQUARE)), ("a", 0, ring(HOLE)), (None, 0, ring(HOLE))], f"region_id string, part int, ring {shapes.RING}")
    path = shapes.to_shapefile(rows, f"file://{tmp_path}/out.zip")
    got = [(r[1], r[2], r[3], r[4]["region_id"]) for r in told(shapes.shapefile(spark, path))]
    assert got == [(0, 0, HOLE[:-1], None), (1, 0, HOLE[:-1], "a"), (2, 0, SQUARE[:-1], "b"), (2, 1, HOLE[:-1], "b")]
    empty = shapes.to_shapefile(rows.where("false"), f"file://{tmp_path}/empty.zip")
    assert shapes.shapefile(spark, empty).count() == 0


def test_well_known_binary(spark):
    flat = lambda rings, o: b"".join(struct.pack(o + "I", len(r)) + b"".join(struct.pack(o + "2d", *p) for p in r) for r in rings)
    plain = struct.pack("<BII", 1, 3, 2) + flat([SQUARE, HOLE], "<")
    big = struct.pack(">BII", 0, 3, 1) + flat([HOLE], ">")
    high = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<3d", *p, 7.0) for p in HOLE)
    placed = struct.pack("<BIII", 1, 3 | 0x20000000, 4326, 1) + flat([HOLE], "<")
    several = struct.pack("<BII", 1, 6, 2) + plain + big
    df = spark.createDataFrame([(i, bytearray(b) if b else None) for i, b in enumerate([plain, big, high, placed, several, None])], "region_id int, geometry binary")
    got = sorted((r["region_id"], r["part"], [tuple(p) for p in r["ring"]]) for r in shapes.rings_from_wkb(df).collect())
    s, h = SQUARE[:-1], HOLE[:-1]
    assert got == [(0, 0, s), (0, 1, h), (1, 0, h), (2, 0, h), (3, 0, h), (4, 0, s), (4, 1, h), (4, 2, h)]
    with pytest.raises(Exception, match="kind 1 "):
        shapes.rings_from_wkb(spark.createDataFrame([(0, bytearray(struct.pack("<BI2d", 1, 1, 0, 0)))], "region_id int, geometry binary")).collect()


def test_zones_from_coordinates_and_clock_change(spark):
    zones = geo.rings_from_wkt(spark.createDataFrame([("America/Los_Angeles", "POLYGON ((-125 30, -114 30, -114 42, -125 42))")], "zone string, wkt string"), key="zone")
    points = spark.createDataFrame([("la", 34.0, -118.2), ("sea", 34.0, -140.0), ("east", 0.0, 179.0), ("zero", 0.0, 3.0), ("lost", None, None)], "station string, lat double, lon double")
    found = geo.zones_of(points, zones, "station")
    assert {r["station"]: r["zone"] for r in found.collect()} == {"la": "America/Los_Angeles", "sea": "Etc/GMT+9", "east": "Etc/GMT-12", "zero": "Etc/GMT", "lost": None}
    times = found.crossJoin(spark.sql("SELECT explode(array(timestamp_ntz'2020-01-01 12:00:00', timestamp_ntz'2020-07-01 12:00:00')) AS time"))
    got = subset.local_time(times, F.col("zone"))
    assert sorted(r["time"].hour for r in got.where("station = 'la'").collect()) == [4, 5]
    assert sorted(r["time"].hour for r in got.where("station = 'sea'").collect()) == [3, 3]
    assert [r["time"] for r in got.where("station = 'lost'").collect()] == [None, None]


def test_user_file_needs_the_columns_and_listing_skips_contents(spark, tmp_path):
    path = str(tmp_path / "own")
    spark.range(3).select(F.lit("a").alias("simulation"), F.lit(1.5).alias("value")).coalesce(1).write.parquet(path)
    with pytest.raises(ValueError, match="warming_level"):
        catalog.from_file(spark, path)
    assert catalog.from_file(spark, path, ("sim", "value")).get().count() == 3
    assert scan.listing(spark, path, "*.parquet").count() == 1
    assert "content" not in scan.listing(spark, path).schema.names
