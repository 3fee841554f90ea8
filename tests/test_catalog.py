import pytest
from pyspark.sql import functions as F

from tephra.functions import derived  # noqa: F401
from tephra.operators import subset, warming
from tephra.sources import catalog, scan, sinks


def frame(spark):
    rows = [("WRF", "UCLA", g, s, "mon", "d01", "r1", v, "K", f"{y}-01-01", 280.0 + y % 10) for g in "AB" for s in ("historical", "ssp370") for v in ("u10", "v10") for y in range(2000, 2006)]
    df = spark.createDataFrame(rows, "activity string, institution string, gcm string, scenario string, table_id string, grid_label string, member string, variable string, units string, t string, value double")
    return df.select("*", F.col("t").cast("timestamp_ntz").alias("time")).drop("t").withColumn("sim", F.concat_ws("_", "gcm", "scenario"))


def test_queries_are_immutable_and_lazy(spark):
    base = catalog.from_frame(frame(spark))
    a = base.gcm("A")
    b = a.scenario("ssp370").variable("u10")
    assert base.facets == {} and a.facets == {"gcm": "A"}
    assert b.get().count() == 6
    assert b.processes({"time_slice": (2001, 2002), "convert_units": "degC"}).get().agg(F.max("value")).first()[0] == pytest.approx(282 - 273.15)
    with pytest.raises(ValueError):
        base.where(colour="red")
    with pytest.raises(ValueError):
        base.processes({"dance": 1})


def test_options_and_dictionary(spark):
    base = catalog.from_frame(frame(spark))
    assert {r[0] for r in base.gcm("A").options("scenario").collect()} == {"historical", "ssp370"}
    assert catalog.from_dict(base, {"gcm": ["A", "B"], "variable": "u10", "processes": {"time_slice": (2000, 2000)}}).get().count() == 4

    class Selection:
        gcm, scenario, variable = "B", "historical", ""

    assert catalog.from_selection(base, Selection()).get().count() == 12


def test_derived_variable(spark):
    got = catalog.from_frame(frame(spark)).variable("wind_speed_10m").get().where("gcm = 'A' and scenario = 'historical'").orderBy("time").first()
    assert got["wind_speed_10m"] == pytest.approx((280.0**2 * 2) ** 0.5)


def test_warming_windows(spark):
    traj = spark.createDataFrame([("s", y, (y - 2000) / 10) for y in range(2000, 2041)], "sim string, year int, value double")
    cross = warming.crossings(traj, [1.5, 9.0], ["sim"])
    assert {r["warming_level"]: r["crossing"] for r in cross.collect()} == {1.5: 2016, 9.0: None}
    df = spark.createDataFrame([("s", f"{y}-{m:02d}-01", 1.0) for y in range(1990, 2041) for m in range(1, 13)], "sim string, t string, value double").select("sim", F.col("t").cast("date").alias("time"), "value")
    got = warming.window_around(df, cross, ["sim"], half=15, dummy_time=True)
    assert got.count() == 360
    row = got.agg(F.min("time_delta"), F.max("time_delta"), F.min("time").cast("string")).first()
    assert tuple(row) == (-180, 179, "2001-01-01")
    assert warming.window_around(df, cross, ["sim"], half=15, months=[7]).count() == 30


def test_year_lookup(spark):
    t = spark.createDataFrame([("Historical", 2000, 0.1, 0.2, 0.3), ("ssp370", 2030, 1.0, 1.6, 2.2), ("ssp370", 2040, 1.7, 2.1, 2.9)], "scenario string, year int, p5 double, mean double, p95 double")
    assert tuple(warming.year_at_level(t, 1.5, "ssp370").first()) == ("ssp370", 2030, 2030, 2040)
    assert warming.level_at_year(t, 2040).first()["mean"] == 2.1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, None, "y")], "k int, `a value` double, time string")
    named = sinks.csv_names(df)
    assert named.columns == ["k", "a_value", "time"]
    p = f"file://{tmp_path}/p"
    sinks.export(named, p)
    sinks.export(named.limit(0), p, method="skip_existing")
    assert spark.read.parquet(p).count() == 2
    sinks.export(named, f"file://{tmp_path}/c", "csv", "data")
    assert scan.csv(spark, f"file://{tmp_path}/c", "k int, a_value double, time string").count() == 2
    sinks.bundle({"one two": named}, f"file://{tmp_path}/b", "area")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/b/area/clean").columns == ["k", "a_value", "file_key"]
    hours = spark.createDataFrame([(h, float(h)) for h in range(24)], "hour_of_year int, t double")
    sinks.weather_file(hours, f"file://{tmp_path}/w", "here", 1.0, 2.0, ["t"])
    lines = [r[0] for r in spark.read.text(f"file://{tmp_path}/w").collect()]
    assert len(lines) == 26 and lines[0].startswith("LOCATION,here") and lines[2] == "0.0"


def test_byte_order_mark_and_repeated_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿year,pr,year\n1950,1.5,1950\n1951,NaN,1951\n")
    got = scan.csv(spark, f"file://{tmp_path}/x.csv", "year int, pr double, year_again int").orderBy("year").collect()
    assert [tuple(r) for r in got] == [(1950, 1.5, 1950), (1951, None, 1951)]


def test_division_and_live_series(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 1, None)], "sim string, x int, value double")
    assert [r[0] for r in subset.relational_division(df, "sim", "x", [1, 2]).collect()] == ["a"]
    assert {r["sim"] for r in subset.live_series(df, ["sim"]).collect()} == {"a"}
