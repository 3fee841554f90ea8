import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tephra.functions import numbers as N
from tephra.functions import weather as X
from tephra.operators import aggregates as A
from tephra.operators import basins, geo, indices, joins, subset


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_nan_is_missing_and_compares_false(spark):
    df = N.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    got = df.select(N.beyond(F.col("v"), 5, "<").alias("a"), N.beyond(F.col("v"), 5, ">").alias("b")).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, False)]
    assert df.agg(F.avg("v")).first()[0] == 1.0


@pytest.mark.parametrize("have,want,x,y", [("K", "degC", 300.0, 26.85), ("K", "degF", 273.15, 32.0), ("kg m-2 s-1", "mm/d", 1.0, 86400.0), ("mm", "inches", 25.4, 1.0), ("Pa", "hPa", 101325.0, 1013.25), ("%", "fraction", 50.0, 0.5)])
def test_units(spark, have, want, x, y):
    assert one(spark, N.convert(F.lit(x), have, want)) == pytest.approx(y)


def test_unknown_units_are_refused():
    with pytest.raises(ValueError):
        N.convert(F.lit(1.0), "K", "mm")


def test_noleap_day(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, N.noleap_day(t("2000-02-29 00:00:00"))) is None
    assert one(spark, N.noleap_day(t("2000-12-31 00:00:00"))) == 365
    assert one(spark, N.noleap_day(t("2001-12-31 00:00:00"))) == 365
    assert one(spark, N.noleap_day(t("1900-03-01 00:00:00"))) == 60
    assert one(spark, N.hour_of_year(t("2000-12-31 23:00:00"))) == 8759


def test_heat_index_table_value(spark):
    assert one(spark, X.heat_index(F.lit(90.0), F.lit(70.0))) == pytest.approx(105.9, abs=0.1)
    assert one(spark, X.heat_index(F.lit(60.0), F.lit(50.0))) < 61


def test_wind_direction(spark):
    assert one(spark, X.wind_direction(F.lit(0.0), F.lit(-1.0))) == pytest.approx(0.0)
    assert one(spark, X.wind_direction(F.lit(-1.0), F.lit(0.0))) == pytest.approx(90.0)


def test_dew_point_is_inverse_of_humidity(spark):
    td = X.dew_point(F.lit(25.0), F.lit(40.0))
    assert one(spark, X.relative_humidity(F.lit(25.0), td)) == pytest.approx(40.0)


@pytest.mark.parametrize("x", [0.1, 0.5, 1.0, 3.7, 40.0])
def test_log_gamma(spark, x):
    assert one(spark, X.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-9)


def test_percentile_and_variances(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "value double").withColumn("k", F.lit(1))
    assert A.quantiles(df, ["k"], [0.99]).first()["q_99"] == pytest.approx(4.96)
    got = A.reduce(df.where("value <= 3"), ["k"], ["var", "var_sample"]).first()
    assert got["var"] == pytest.approx(2 / 3) and got["var_sample"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        A.reduce(df, ["k"], ["nonsense"])


def test_bins_close_the_last_edge(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (10.1,), (-0.1,)], "v double")
    assert [r[0] for r in df.select(A.bins(F.col("v"), 0, 10, 5)).collect()] == [0, 4, 4, None, None]


def test_mode_takes_the_least_on_ties(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1), ("a", None)], "k string, v int")
    assert tuple(A.mode(df, ["k"], "v").first()) == ("a", 1, 2)


def test_degree_days(spark):
    h, c = indices.degree_days(F.lit(60.0), F.lit(40.0), 60, 70)
    assert one(spark, h) == 10 and one(spark, c) == 0


def test_effective_temperature(spark):
    rows = [("a", 1, 80.0, 60.0), ("a", 2, 90.0, 65.0), ("a", 3, 100.0, 70.0)]
    got = indices.effective_temperature(spark.createDataFrame(rows, "sim string, time int, tmax double, tmin double"), ["sim"]).orderBy("time").collect()
    assert [r["teff"] if r["teff"] is None else round(r["teff"], 6) for r in got] == [None, None, 99.3]


def test_basin_weights(spark):
    df = spark.createDataFrame([(1, "a", 100.0), (2, "a", 150.0), (3, "a", 200.0), (1, "b", 50.0), (2, "b", 75.0), (3, "b", 100.0)], "t int, region_id string, pr double")
    w = spark.createDataFrame([("a", 0.3), ("b", 1.0)], "region_id string, weight double")
    got = [r["pr"] for r in basins.weighted_total(df.where("region_id = 'a'"), w, ["t"], ["pr"]).orderBy("t").collect()]
    assert got == pytest.approx([30, 45, 60])
    one_each = w.withColumn("weight", F.lit(1.0))
    assert [r["pr"] for r in basins.weighted_total(df, one_each, ["t"], ["pr"]).orderBy("t").collect()] == [150, 225, 300]
    assert basins.output_name("CESM2", "historical", "r1i1p1f1", "19FlowWeighted") == "CESM2_historical_r1i1p1f1_19FlowWeighted.csv"


def test_partial_dates():
    assert subset.span("1996") == (datetime(1996, 1, 1), datetime(1997, 1, 1))
    assert subset.span("February 2000") == (datetime(2000, 2, 1), datetime(2000, 3, 1))
    assert subset.span("1999-12-31") == (datetime(1999, 12, 31), datetime(2000, 1, 1))
    with pytest.raises(ValueError):
        subset.span("not a date")


def test_point_on_two_polygons_takes_the_first(spark):
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    polygons = spark.createDataFrame([(2, box(0.0, 0.0, 3.0, 3.0)), (1, box(1.0, 1.0, 4.0, 4.0))], "region_id int, ring array<struct<lon: double, lat: double>>")
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.5, 0.5), (3, 9.0, 9.0), (4, None, 1.0)], "p int, lat double, lon double")
    got = {r["p"]: r["region_id"] for r in geo.region_mask(points, polygons, "p").collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None}


def test_nearest_cell_ties_take_the_lesser_key(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "point int, lat double, lon double")
    cells = spark.createDataFrame([(8, 0.0, 0.5), (7, 0.0, -0.5), (9, 3.0, 0.0)], "cell int, lat double, lon double")
    assert joins.nearest_cell(points, cells, "point", "cell", 1.0).first()["cell"] == 7


def test_merge_is_a_full_join(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, value double")
    b = spark.createDataFrame([(2, 20.0), (3, 30.0)], "k int, value double")
    assert [tuple(r) for r in joins.merge({"a": a, "b": b}, ["k"]).orderBy("k").collect()] == [(1, 1.0, None), (2, 2.0, 20.0), (3, None, 30.0)]


def test_outlines(spark):
    cells = spark.createDataFrame([(float(x), float(y)) for x in (0, 1, 3) for y in (0, 2)], "x double, y double")
    got = {(r["x"], r["y"]): (r["west"], r["east"], r["south"], r["north"]) for r in geo.cell_outlines(cells).collect()}
    assert got[1.0, 0.0] == (0.5, 2.0, -1.0, 1.0) and got[3.0, 2.0] == (2.0, 4.0, 1.0, 3.0)


def test_local_time_is_trimmed(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 10:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("time"))
    assert subset.local_time(df, "America/Los_Angeles", reindex=True).count() == 1
    assert subset.local_time(df, "America/Los_Angeles").agg(F.min("time")).first()[0] == datetime(2023, 12, 31, 16)


def test_slice_reaches_the_scan(spark):
    df = subset.time_slice(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "1996", "1997", "o_orderdate")
    assert "GreaterThanOrEqual(o_orderdate" in df._jdf.queryExecution().executedPlan().toString()
    assert df.agg(F.max("o_orderdate")).first()[0].date() <= date(1997, 12, 31)


def test_outlines_of_repeated_coordinates(spark):
    rows = [(i, 0.5 * (i // 3 % 3), 0.25 * (i % 3)) for i in range(27)]  # a grid of 3 x 3 three times over
    got = geo.cell_outlines(spark.createDataFrame([*rows, (99, None, 1.0)], "cell int, lon double, lat double"), "lon", "lat").collect()
    assert len(got) == 28
    for r in got:
        if r["cell"] == 99:
            assert r["west"] is None and r["north"] is None
        else:
            assert (r["west"], r["east"], r["south"], r["north"]) == (r["lon"] - 0.25, r["lon"] + 0.25, r["lat"] - 0.125, r["lat"] + 0.125)


def test_outlines_are_of_every_cell(spark):
    import duckdb

    from tephra.plans.catalog_queries import ORACLES, QUERIES

    sf, con = "/root/testdata/sf0.1", duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    got = {r["cell"]: tuple(r)[1:] for r in QUERIES["J44_cell_outlines"](spark, sf).collect()}
    assert set(got) == {x for (x,) in con.execute("SELECT DISTINCT l_suppkey FROM lineitem").fetchall()} and len(got) > 100
    for cell, *sides in con.execute(ORACLES["J44_cell_outlines"]).fetchall():  # the SQL has the cells below 100
        assert got[cell] == pytest.approx(tuple(sides))


def test_interpolation_equals_numpy(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tephra.operators.bias import interpolated

    g = np.random.default_rng(4)
    rows = []
    for i in range(60):
        xs = np.sort(np.round(g.normal(size=7), 1))  # with ties
        rows.append((i, float(xs[i % 7] if i % 3 == 0 else g.normal() * 2), xs.tolist(), g.normal(size=7).tolist()))
    df = spark.createDataFrame([*rows, (99, None, [1.0], [2.0]), (98, 5.0, None, [2.0])], "id int, x double, xs array<double>, ys array<double>")
    got = {r["id"]: r["y"] for r in df.select("id", interpolated(F.col("x"), F.col("xs"), F.col("ys")).alias("y")).collect()}
    assert got.pop(99) is None and got.pop(98) is None
    for i, x, xs, ys in rows:
        k = int(np.searchsorted(xs, x, side="right"))
        want = ys[0] if k == 0 else ys[-1] if k >= 7 else ys[k - 1] + (ys[k] - ys[k - 1]) * (x - xs[k - 1]) / (xs[k] - xs[k - 1])
        assert abs(got[i] - want) < 1e-12 and (len(set(xs)) < 7 or abs(got[i] - np.interp(x, xs, ys)) < 1e-9)


def test_sea_cells_do_not_dilute_a_stress_event(spark):
    from pyspark.sql import functions as F

    from tephra.operators import events

    rows = [("a", c, f"2001-07-0{t}", 40.0 if c < 2 else None, 25.0 if c < 2 else None) for c in range(10) for t in (1, 2, 3)]
    df = spark.createDataFrame(rows, "sim string, cell int, t string, tmax double, tmin double").withColumn("time", F.col("t").cast("date"))
    state = events.spatial_condition(df, ["sim", "time"], F.col("tmax") > 35, 0.5, "tmax")
    assert [str(r["time"]) for r in events.stress_events(df, state, 35, 20, days=3).collect()] == ["2001-07-03"]
    none = df.select("cell").where("cell > 5")
    assert events.stress_events(df, state, 35, 20, days=3, mask=none).count() == 0


def test_density_of_values_far_from_the_grid(spark):
    import duckdb

    from tephra.plans.catalog_queries import ORACLES, QUERIES

    sf, con = "/root/testdata/sf0.1", duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    shown = lambda d: "NaN" if d is not None and math.isnan(d) else d
    got = sorted((r["scenario"], r["i"], shown(r["density"])) for r in QUERIES["J37_kernel_density"](spark, sf).collect())
    assert got == sorted((s, i, shown(d)) for s, i, d in con.execute(ORACLES["J37_kernel_density"]).fetchall())
    assert [d for s, _, d in got if s == "P"] == ["NaN"] * 41 and ("O", 40, 1.0) in got


def test_density_of_alike_and_missing_values(spark):
    from tephra.operators import ensemble

    rows = [("alike", 2.0), ("alike", 2.0), ("between", 2.5), ("between", 2.5), ("far", 9000.0), ("far", 9001.0), ("missing", None), ("missing", None), ("one", 2.0), ("some", None), ("some", 1.0), ("some", 3.0)]
    got = {}
    for r in ensemble.density(spark.createDataFrame(rows, "k string, value double"), ["k"], 0.0, 4.0, points=5).orderBy("k", "i").collect():
        got.setdefault(r["k"], []).append(r["density"])
    assert all(len(got[k]) == 5 and all(math.isnan(d) for d in got[k]) for k in ("alike", "between", "far"))
    assert got["missing"] == got["one"] == [None] * 5
    h = math.sqrt(2) / 2
    sums = [math.exp(-0.5 * ((x - 1) / h) ** 2) + math.exp(-0.5 * ((x - 3) / h) ** 2) for x in range(5)]
    assert got["some"] == pytest.approx([s / max(sums) for s in sums])
