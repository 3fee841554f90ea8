import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.functions import fits
from tephra.operators import bias, extremes, indices, profiles


@pytest.mark.parametrize("kind", sorted(fits.FITS))
def test_quantile_inverts_cdf(kind):
    x = np.random.default_rng(1).gumbel(50, 8, 200)
    p = fits.FITS[kind](x)
    for q in (0.1, 0.5, 0.9, 0.99):
        assert fits.cdf(kind, p, fits.quantile(kind, p, q)) == pytest.approx(q, abs=1e-6)


@pytest.mark.parametrize("kind", ["gev", "gumbel", "pearson3", "weibull"])
def test_fits_describe_their_sample(kind):
    x = np.random.default_rng(2).gumbel(50, 8, 400)
    p = fits.FITS[kind](x)
    d, pv = fits.ks_fit(kind, p, x)
    assert d < 0.08
    assert abs(fits.quantile(kind, p, 0.5) - np.median(x)) < 1.5


def test_gev_recovers_parameters():
    u = np.random.default_rng(3).random(4000)
    x = np.array([fits.quantile("gev", (0.15, 100.0, 20.0), q) for q in u])
    k, loc, scale = fits.FITS["gev"](x)
    assert (k, loc, scale) == (pytest.approx(0.15, abs=0.04), pytest.approx(100, abs=1.5), pytest.approx(20, abs=1.5))


def test_column_fit_equals_numpy_fit(spark):
    x = np.random.default_rng(4).gumbel(10, 2, 60)
    df = spark.createDataFrame([("a", float(v)) for v in x], "sim string, value double")
    row = extremes.gev_parameters(df, ["sim"]).first()
    assert (row["shape"], row["location"], row["scale"]) == pytest.approx(fits.FITS["gev"](x))
    ret = {r["one_in_x"]: r["return_value"] for r in extremes.gev_return_values(extremes.gev_parameters(df, ["sim"]), ["sim"], [10]).collect()}
    assert ret[10] == pytest.approx(fits.quantile("gev", fits.FITS["gev"](x), 0.9))
    p = extremes.gev_exceedance(extremes.gev_parameters(df, ["sim"]), ["sim"], ret[10]).first()
    assert p["return_period"] == pytest.approx(10.0)


def test_series_fit_is_repeatable_and_skips_short_series(spark):
    x = np.random.default_rng(5).gumbel(10, 2, 40)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)], "sim string, value double")
    runs = [[tuple(r) for r in extremes.fit_series(df, ["sim"], [10], bootstraps=20).collect()] for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 1
    _, _, value, low, high, d, p = runs[0][0]
    assert low <= value <= high and 0 <= d <= 1 and 0 <= p <= 1
    with pytest.raises(ValueError):
        extremes.fit_series(df, ["sim"], [10], "cauchy")


def test_two_sample_ks_equals_numpy(spark):
    g = np.random.default_rng(6)
    a, b = g.normal(0, 1, 80).round(1), g.normal(0.8, 1, 60).round(1)
    frame = lambda v: spark.createDataFrame([("k", float(x)) for x in v], "k string, value double")
    got = extremes.ks_between(frame(a), frame(b), ["k"], level=None).first()
    d, p = fits.ks_two(a, b)
    assert got["d"] == pytest.approx(d) and got["p"] == pytest.approx(p, abs=1e-9)
    assert extremes.ks_between(frame(a), frame(a), ["k"]).count() == 0


def test_gamma_fit_and_incomplete_gamma():
    x = np.random.default_rng(7).gamma(3.0, 2.0, 5000)
    shape, scale = fits.gamma_fit(x)
    assert shape == pytest.approx(3.0, abs=0.2) and shape * scale == pytest.approx(x.mean())
    assert fits.gamma_p(1.0, 2.0) == pytest.approx(1 - np.exp(-2.0))


def daily(spark, seed, shift, years=(2000, 2003)):
    g = np.random.default_rng(seed)
    rows = [("m", str(t), float(v)) for t, v in zip(np.arange(f"{years[0]}-01-01", f"{years[1]}-01-01", dtype="datetime64[D]"), g.normal(shift, 2.0, 2000), strict=False)]
    return spark.createDataFrame(rows, "sim string, t string, value double").select("sim", F.col("t").cast("date").alias("time"), "value")


def test_mapping_removes_a_constant_bias(spark):
    obs, model = daily(spark, 8, 10.0), daily(spark, 8, 13.0)
    got = bias.quantile_delta_mapping(obs, model, ["sim"], (2000, 2002), half_window=45)
    error = got.join(obs.withColumnRenamed("value", "o"), ["sim", "time"]).agg(F.max(F.abs(F.col("adjusted") - F.col("o")))).first()[0]
    assert error < 1e-6


def test_standardised_index_is_monotone_and_clipped(spark):
    rows = [("a", f"{2000 + i}-01-01", float(v)) for i, v in enumerate([0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 500.0])]
    df = spark.createDataFrame(rows, "sim string, t string, value double").select("sim", F.col("t").cast("date").alias("time"), "value")
    got = [r["index"] for r in indices.standardised_index(df, ["sim"], (2000, 2005)).orderBy("time").collect()]
    assert got == sorted(got) and got[-1] == 2.5


def test_drought_index_follows_rain(spark):
    wet = [("a", f"{2000 + i // 12}-{i % 12 + 1:02d}-01", 3.0 if i < 60 else 0.2, 2.0) for i in range(120)]
    df = spark.createDataFrame(wet, "sim string, t string, precip double, pet double").select("sim", F.col("t").cast("date").alias("time"), "precip", "pet")
    x = [r["pdsi"] for r in indices.palmer(df, ["sim"]).orderBy("time").collect()]
    assert x[55] > 0 > x[-1]


def test_medoid_and_typical_months(spark):
    rows = [("a", y, d, 0, float(v)) for y, shift in ((1, 0.0), (2, 5.0), (3, 1.0)) for d, v in enumerate([shift, shift + 1])]
    df = spark.createDataFrame(rows, "sim string, year int, doy int, hour int, value double")
    assert profiles.medoid_year(df, ["sim"]).first()["year"] == 3


def test_ramp_never_lowers_a_maximum(spark):
    profile = spark.createDataFrame([("a", h, 10.0) for h in range(100)], "sim string, hour_of_year int, value double")
    event = spark.createDataFrame([("a", 30.0)], "sim string, return_value double")
    got = {r["hour_of_year"]: r["value"] for r in profiles.insert_event(profile, event, ["sim"], at=50, half=10).collect()}
    assert got[50] == 30.0 and got[45] == 20.0 and got[40] == 10.0 and got[0] == 10.0


def test_registered_fits_and_mappings_have_the_whole_window(spark, monkeypatch):
    import inspect

    from tephra.plans import catalog_queries

    seen = {}
    for module, name in ((bias, "quantile_delta_mapping"), (extremes, "fit_series")):
        whole = inspect.signature(getattr(module, name))
        monkeypatch.setattr(module, name, lambda *a, whole=whole, **k: (b := whole.bind(*a, **k)).apply_defaults() or seen.update(b.arguments))
    for name in ("J04_fit_with_ks", "J05_quantile_delta_mapping"):
        catalog_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen["half_window"] == 45 and seen["bootstraps"] == 100


def test_palmer_spells():
    recursion = lambda z, x=0.0: [x := 0.897 * x + a / 3 for a in z]
    z = [-1.0] * 12
    assert np.allclose(indices.palmer_spells(np.array(z)), recursion(z))  # only dry: one sum throughout
    z = [-3.0] * 6 + [0.5] + [-3.0] * 3  # one wet month doesn't end a drought: the sum goes on
    assert np.allclose(indices.palmer_spells(np.array(z)), recursion(z))
    z = [-3.0] * 4 + [2.0, 2.0, 2.0, 2.0]  # against a sum of -3.42 it takes four wet months; from the first of them on the wet sums count
    got = indices.palmer_spells(np.array(z))
    assert np.allclose(got[:4], recursion(z[:4])) and np.allclose(got[4:], recursion(z[4:]))
    z = [-3.0] * 4 + [2.0, 2.0]  # still in doubt at the end: the drought's sum
    assert np.allclose(indices.palmer_spells(np.array(z)), recursion(z))
    z = [0.6, -0.3, -0.9, -3.0]  # a wet sum of 0.2 and 0.079 dies away; the dry one, begun in the second month, outlasts it
    assert np.allclose(indices.palmer_spells(np.array(z)), [0.2, -0.1, 0.897 * -0.1 - 0.3, 0.897 * (0.897 * -0.1 - 0.3) - 1.0])
    z = np.random.default_rng(1).normal(0, 2, 400)
    assert np.allclose(indices.palmer_spells(-z), -indices.palmer_spells(z))  # wet and dry mirror each other
    assert indices.palmer_spells(np.zeros(0)).shape == (0,)
