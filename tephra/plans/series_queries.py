"""Queries for aggregations, windows, events, extremes, profiles, ensembles, indices, basins and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import weather as X
from ..operators import aggregates as A
from ..operators import basins, bias, ensemble, events, extremes, geo, indices, profiles, subset, warming
from ..operators import windows as W
from ..sources import scan
from ..streaming import series as stream
from .base import DAILY, GRID, HOURLY, MONTHLY, SCEN, YEARLY, query
from .subset_queries import monthly, yearly


def r(c, n=6):
    return F.round(c, n)


@query("D01_reductions", f"WITH {DAILY} SELECT sim, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS median, round(sum(value), 2) AS sum, min(value) AS min, max(value) AS max FROM daily GROUP BY 1")
def d01(spark, d):
    got = A.reduce(scan.daily(spark, d), ["sim"], ["mean", "median", "sum", "min", "max"])
    return got.select("sim", r("mean", 5).alias("mean"), r("median", 5).alias("median"), r("sum", 2).alias("sum"), "min", "max")


@query("D03_exceedance_rate", f"WITH {DAILY} SELECT sim, round(sum(CASE WHEN value > 45000 THEN 1 ELSE 0 END) / 7.0, 6) AS rate FROM daily GROUP BY 1")
def d03(spark, d):
    return scan.daily(spark, d).groupBy("sim").agg(r(A.exceedance_rate(F.col("value") > 45000, F.lit(7.0))).alias("rate"))


@query("D05_valid_cell_fraction", f"WITH {GRID} SELECT sim, year, round(count(*) FILTER (WHERE value > 38000) / count(*), 6) AS fraction, count(*) FILTER (WHERE value > 38000) / count(*) >= 0.5 AS hit FROM grid GROUP BY 1, 2")
def d05(spark, d):
    got = events.spatial_condition(scan.grid(spark, d), ["sim", "year"], F.col("value") > 38000)
    return got.withColumn("fraction", r("fraction"))


@query("D06_calendar_groups", f"WITH {HOURLY} SELECT sim, CAST(hour(time) AS INT) AS hour, round(avg(value), 4) AS mean FROM hourly GROUP BY 1, 2")
def d06(spark, d):
    return A.reduce(scan.hourly(spark, d).withColumn("hour", F.hour("time")), ["sim", "hour"], ["mean"]).withColumn("mean", r("mean", 4))


@query("D07_resample_month", f"WITH {DAILY} SELECT sim, CAST(date_trunc('month', time) AS DATE) AS time, round(avg(value), 5) AS value FROM daily GROUP BY 1, 2")
def d07(spark, d):
    return A.resample(scan.daily(spark, d), ["sim"], "month").withColumn("value", r("value", 5))


@query("D09_exact_quantiles", f"WITH {DAILY} SELECT sim, round(quantile_cont(value, 0.05), 6) AS q_5, round(quantile_cont(value, 0.5), 6) AS q_50, round(quantile_cont(value, 0.99), 6) AS q_99 FROM daily GROUP BY 1")
def d09(spark, d):
    q = A.quantiles(scan.daily(spark, d), ["sim"], [0.05, 0.5, 0.99])
    return q.select("sim", *[r(c).alias(c) for c in ("q_5", "q_50", "q_99")])


@query("D10_yearly_percentiles", f"WITH {SCEN} SELECT CAST(year(time) AS INT) AS year, round(quantile_cont(value, 0.1), 6) AS q_10, round(quantile_cont(value, 0.25), 6) AS q_25, round(quantile_cont(value, 0.75), 6) AS q_75, round(quantile_cont(value, 0.9), 6) AS q_90 FROM scen GROUP BY 1")
def d10(spark, d):
    q = A.quantiles(scan.scenarios(spark, d).withColumn("year", F.year("time")), ["year"], [0.1, 0.25, 0.75, 0.9])
    return q.select("year", *[r(c).alias(c) for c in q.columns[1:]])


@query("D11_variances", f"WITH {DAILY} SELECT sim, round(var_pop(wind), 9) AS var, round(stddev_pop(wind), 9) AS std, round(var_samp(wind), 9) AS var_sample FROM daily GROUP BY 1")
def d11(spark, d):
    v = A.reduce(scan.daily(spark, d), ["sim"], ["var", "std", "var_sample"], "wind")
    return v.select("sim", *[r(c, 9).alias(c) for c in ("var", "std", "var_sample")])


@query("D12_any_all", f"WITH {DAILY} SELECT sim, bool_or(value > 100000) AS any_hot, bool_and(value > 900) AS all_warm FROM daily GROUP BY 1")
def d12(spark, d):
    return scan.daily(spark, d).groupBy("sim").agg(F.bool_or(F.col("value") > 100000).alias("any_hot"), F.bool_and(F.col("value") > 900).alias("all_warm"))


@query("D13_argmin_argmax", f"WITH {DAILY} SELECT sim, arg_min(time, (value, time)) AS argmin, arg_min(time, (-value, time)) AS argmax FROM daily GROUP BY 1")
def d13(spark, d):
    return A.arg_extremes(scan.daily(spark, d), ["sim"], "value", "time")


@query("D14_mode", "SELECT l_returnflag, l_quantity, n FROM (SELECT l_returnflag, l_quantity, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def d14(spark, d):
    return A.mode(scan.table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query("D16_month_weighted_mean", f"WITH {MONTHLY} SELECT scenario, gcm, CAST(year(time) AS INT) AS year, round(sum(value * day(last_day(time))) / sum(day(last_day(time))), 5) AS value FROM monthly GROUP BY 1, 2, 3")
def d16(spark, d):
    return A.month_weighted(monthly(spark, d), ["scenario", "gcm"]).withColumn("value", r("value", 5))


@query("D17_area_mean", f"WITH {GRID} SELECT sim, year, round(sum(value * cos(radians(lat))) / sum(cos(radians(lat))), 5) AS value FROM grid GROUP BY 1, 2")
def d17(spark, d):
    return A.area_mean(scan.grid(spark, d), ["sim", "year"]).withColumn("value", r("value", 5))


@query("D18_basin_weighted_sum", f"WITH {GRID}, b AS (SELECT sim, year, cell % 20 AS region_id, avg(value) AS value FROM grid GROUP BY 1, 2, 3) SELECT sim, year, round(sum(coalesce(value * CASE WHEN region_id IN (0, 14) THEN 0 ELSE (region_id + 1) / 210.0 END, 0)), 5) AS value FROM b GROUP BY 1, 2")
def d18(spark, d):
    g = scan.grid(spark, d)
    mask = g.select("cell").distinct().withColumn("region_id", F.col("cell") % 20)
    weights = scan.literal(spark, [(i, 0.0 if i in (0, 14) else (i + 1) / 210.0) for i in range(20)], "region_id long, weight double")
    by = basins.basin_means(g, mask, ["sim", "year"], ["cell"], ["value"])
    return basins.weighted_total(by, weights, ["sim", "year"], ["value"]).withColumn("value", r("value", 5))


@query("D20_equal_model_weight", f"WITH {YEARLY} SELECT year, round(avg(m), 5) AS value FROM (SELECT gcm, year, avg(value) AS m FROM yearly GROUP BY 1, 2) GROUP BY 1")
def d20(spark, d):
    return A.equal_gcm_mean(yearly(spark, d), ["year"]).withColumn("value", r("value", 5))


@query("D21_ensemble_rows", f"WITH {YEARLY}, s AS (SELECT year, scenario || gcm AS sim, value FROM yearly) SELECT year, sim, round(value, 5) AS value FROM s UNION ALL SELECT year, 'mean', round(avg(value), 5) FROM s GROUP BY 1 UNION ALL SELECT year, 'min', round(min(value), 5) FROM s GROUP BY 1 UNION ALL SELECT year, 'max', round(max(value), 5) FROM s GROUP BY 1 UNION ALL SELECT year, 'median', round(quantile_cont(value, 0.5), 5) FROM s GROUP BY 1")
def d21(spark, d):
    y = yearly(spark, d).select("year", F.concat("scenario", "gcm").alias("sim"), "value")
    return A.with_ensemble_rows(y, ["year"]).withColumn("value", r("value", 5))


@query("D23_trend", f"WITH {YEARLY} SELECT scenario, gcm, round(regr_slope(value, year), 4) AS slope, round(regr_intercept(value, year), 1) AS intercept FROM yearly GROUP BY 1, 2")
def d23(spark, d):
    t = A.trend(yearly(spark, d), ["scenario", "gcm"], "year", "value")
    return t.select("scenario", "gcm", r("slope", 4).alias("slope"), r("intercept", 1).alias("intercept"))


BIN = "CASE WHEN value >= 0 AND value < 100000 THEN least(CAST(floor(value / 5000.0) AS INT), 19) WHEN value = 100000 THEN 19 END"


@query("D24_histogram", f"WITH {DAILY} SELECT sim, {BIN} AS bin, count(*) AS count FROM daily WHERE {BIN} IS NOT NULL GROUP BY 1, 2")
def d24(spark, d):
    return A.histogram(scan.daily(spark, d), ["sim"], 0.0, 100000.0, 20)


@query("D25_wind_rose", "WITH b AS (SELECT o_orderstatus AS sim, o_totalprice % 360 AS dir, (o_totalprice % 2000) / 100 AS speed FROM orders), c AS (SELECT sim, CAST(floor((dir + 11.25) / 22.5) % 16 AS INT) AS sector, (speed >= 5)::INT + (speed >= 10)::INT + (speed >= 15)::INT AS speed_class, count(*) AS n FROM b GROUP BY 1, 2, 3) SELECT sim, sector, speed_class, n, round(100.0 * n / sum(n) OVER (PARTITION BY sim), 6) AS percent FROM c")
def d25(spark, d):
    b = scan.table(spark, d, "orders").select(F.col("o_orderstatus").alias("sim"), (F.col("o_totalprice") % 360).alias("dir"), ((F.col("o_totalprice") % 2000) / 100).alias("speed"))
    return A.wind_rose(b, ["sim"], "speed", "dir", [0, 5, 10, 15]).withColumn("percent", r("percent"))


@query("D26_empirical_cdf", f"WITH {DAILY}, h AS (SELECT sim, {BIN} AS bin, count(*) AS count FROM daily WHERE {BIN} IS NOT NULL GROUP BY 1, 2) SELECT sim, bin, count, round(count / sum(count) OVER (PARTITION BY sim), 9) AS share, round(sum(count) OVER (PARTITION BY sim ORDER BY bin) / sum(count) OVER (PARTITION BY sim), 9) AS cdf FROM h")
def d26(spark, d):
    c = A.empirical_cdf(scan.daily(spark, d), ["sim"], 0.0, 100000.0, 20)
    return c.withColumn("share", r("share", 9)).withColumn("cdf", r("cdf", 9))


@query("D27_pooled_quantiles", f"WITH {DAILY} SELECT round(quantile_cont(value, 0.9), 5) AS pooled, (SELECT round(avg(q), 5) FROM (SELECT quantile_cont(value, 0.9) AS q FROM daily GROUP BY sim)) AS mean_of_sims FROM daily")
def d27(spark, d):
    return ensemble.pooled_and_mean_quantiles(scan.daily(spark, d), "sim", 0.9).select(r("pooled", 5).alias("pooled"), r("mean_of_sims", 5).alias("mean_of_sims"))


@query("D28_ensemble_spread", f"""WITH {YEARLY}, c AS (SELECT scenario, year, value / 10000 - 15 AS value FROM yearly), a AS (SELECT scenario, year, max(value) - min(value) AS range, 100.0 * count(*) FILTER (WHERE value > 0) / count(*) AS agree_pct, avg(value) AS m, stddev_pop(value) AS s,
quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS q90 FROM c GROUP BY 1, 2)
SELECT scenario, year, round(range, 6) AS range, round(agree_pct, 6) AS agree_pct, round(m / greatest(s, 0.01), 6) AS snr, round(s / greatest(abs(m), 0.05), 6) AS cv, round(q75 - q25, 6) AS iqr, round(q90 - q10, 6) AS p10_p90, round((q75 - q25) / abs(q50), 5) AS iqr_ratio FROM a""")
def d28(spark, d):
    y = yearly(spark, d).withColumn("value", F.col("value") / 10000 - 15)
    got = A.spread(y, ["scenario", "year"])
    return got.select("scenario", "year", *[r(c, 5 if c == "iqr_ratio" else 6).alias(c) for c in got.columns[2:]])


@query("D32_missing_audit", f"WITH {DAILY} SELECT sim, count(*) AS rows, count(*) FILTER (WHERE value > 60000) AS missing, round(100.0 * count(*) FILTER (WHERE value > 60000) / count(*), 6) AS missing_pct FROM daily GROUP BY 1")
def d32(spark, d):
    df = scan.daily(spark, d).withColumn("value", F.when(~(F.col("value") > 60000), F.col("value")))
    return A.audit(df, ["sim"]).withColumn("missing_pct", r("missing_pct"))


@query("D33_first_crossing", f"WITH {YEARLY} SELECT scenario, gcm, min(CASE WHEN value > 152000 THEN year END) AS crossing FROM yearly GROUP BY 1, 2")
def d33(spark, d):
    return A.first_crossing(yearly(spark, d), ["scenario", "gcm"], 152000)


@query("D34_horizon_means", f"WITH {YEARLY}, h(horizon, a, b) AS (VALUES ('near', 1995, 1997), ('far', 1999, 2001)), m AS (SELECT scenario, horizon, gcm, avg(value) AS m FROM yearly JOIN h ON year BETWEEN a AND b GROUP BY 1, 2, 3) SELECT scenario, horizon, round(avg(m), 5) AS mean, round(min(m), 5) AS lo, round(max(m), 5) AS hi, round(avg(m) - stddev_pop(m), 5) AS lo_std, round(avg(m) + stddev_pop(m), 5) AS hi_std FROM m GROUP BY 1, 2")
def d34(spark, d):
    got = A.horizon_means(yearly(spark, d), [("near", 1995, 1997), ("far", 1999, 2001)], ["scenario"], sim="gcm")
    return got.select("scenario", "horizon", *[r(c, 5).alias(c) for c in got.columns[2:]])


@query("D35_model_ranges", f"WITH {YEARLY} SELECT year, gcm, round(max(value), 6) AS max, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS median FROM yearly GROUP BY 1, 2")
def d35(spark, d):
    g = ensemble.gcm_ranges(yearly(spark, d), ["year"])
    return g.select("year", "gcm", r("max").alias("max"), r("min").alias("min"), r("median").alias("median"))


ROWS = "OVER (PARTITION BY sim ORDER BY time ROWS BETWEEN {} AND {})"


def over(a, b):
    return ROWS.format(a, b)


@query("E01_rolling_median", f"WITH {HOURLY} SELECT sim, time, CASE WHEN count(value) {over('23 PRECEDING', 'CURRENT ROW')} >= 24 THEN round(quantile_cont(value, 0.5) {over('23 PRECEDING', 'CURRENT ROW')}, 6) END AS value FROM hourly")
def e01(spark, d):
    return scan.hourly(spark, d).select("sim", "time", r(W.rolling("median", F.col("value"), 24, ["sim"])).alias("value"))


@query("E02_rolling_sum", f"WITH {DAILY} SELECT sim, time, CASE WHEN count(rain) {over('2 PRECEDING', 'CURRENT ROW')} >= 3 THEN round(sum(rain) {over('2 PRECEDING', 'CURRENT ROW')}, 3) END AS rain FROM daily")
def e02(spark, d):
    return scan.daily(spark, d).select("sim", "time", r(W.rolling("sum", F.col("rain"), 3, ["sim"]), 3).alias("rain"))


@query("E03_rolling_any", f"WITH {DAILY} SELECT sim, time, max(CASE WHEN wind > 0.08 THEN 1 ELSE 0 END) {over('2 PRECEDING', 'CURRENT ROW')} = 1 AS windy FROM daily")
def e03(spark, d):
    return scan.daily(spark, d).select("sim", "time", W.rolling_any(F.col("wind") > 0.08, 3, ["sim"]).alias("windy"))


@query("E05_centred_mean", f"WITH {DAILY} SELECT sim, time, CASE WHEN count(value) {over('5 PRECEDING', '4 FOLLOWING')} >= 5 THEN round(avg(value) {over('5 PRECEDING', '4 FOLLOWING')}, 5) END AS value FROM daily")
def e05(spark, d):
    return scan.daily(spark, d).select("sim", "time", r(W.rolling("mean", F.col("value"), 10, ["sim"], min_periods=5, center=True), 5).alias("value"))


@query("E06_consecutive_days", f"WITH {DAILY} SELECT sim, CAST(count(*) AS BIGINT) AS n FROM (SELECT sim, sum(CASE WHEN value > 38000 THEN 1 ELSE 0 END) {over('2 PRECEDING', 'CURRENT ROW')} AS k FROM daily) WHERE k >= 3 GROUP BY 1")
def e06(spark, d):
    df = scan.daily(spark, d).withColumn("hit", W.consecutive(F.col("value") > 38000, 3, ["sim"]))
    return df.where("hit").groupBy("sim").agg(F.count("*").alias("n"))


@query("E07_event_starts", f"WITH {DAILY} SELECT sim, time, sum(CASE WHEN value > 38000 THEN 1 ELSE 0 END) {over('CURRENT ROW', '2 FOLLOWING')} >= 3 AS hit FROM daily")
def e07(spark, d):
    return scan.daily(spark, d).select("sim", "time", W.starts_of(F.col("value") > 38000, 3, ["sim"]).alias("hit"))


RUNS = "r AS (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY time) - row_number() OVER (PARTITION BY sim, s ORDER BY time) AS g FROM b)"


@query("E08_run_hits", f"WITH {DAILY}, b AS (SELECT sim, time, CASE WHEN value > 42000 THEN 1 WHEN value < 34000 THEN -1 ELSE 0 END AS s FROM daily), {RUNS} SELECT sim, time, CASE WHEN count(*) OVER (PARTITION BY sim, s, g) >= 3 THEN s ELSE 0 END AS hit FROM r")
def e08(spark, d):
    v = F.col("value")
    return W.run_hits(scan.daily(spark, d), v > 42000, v < 34000, 3, ["sim"]).select("sim", "time", "hit")


@query("E09_run_segments", f"WITH {DAILY}, b AS (SELECT sim, time, CASE WHEN value > 40000 THEN 1 ELSE 0 END AS s FROM daily), {RUNS} SELECT sim, s = 1 AS hot, CAST(max(n) AS INT) AS longest, count(*) AS runs FROM (SELECT sim, s, g, count(*) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2")
def e09(spark, d):
    df = W.with_runs(scan.daily(spark, d).withColumn("hot", F.col("value") > 40000), F.col("hot"), ["sim"])
    return df.groupBy("sim", "hot").agg(F.max("run_length").alias("longest"), F.countDistinct("run_id").alias("runs"))


@query("E11_step_lengths", f"WITH {HOURLY}, s AS (SELECT (epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY sim ORDER BY time))) / 3.6e9 AS hours FROM hourly) SELECT hours, count(*) AS n FROM s GROUP BY 1")
def e11(spark, d):
    return scan.hourly(spark, d).select(W.step_hours(["sim"]).alias("hours")).groupBy("hours").agg(F.count("*").alias("n"))


@query("E12_sliding_climatology", f"WITH {MONTHLY} SELECT scenario, gcm, CAST(y AS INT) AS start_year, CAST(month(time) AS INT) AS month, round(avg(value), 5) AS value FROM monthly, range(1995, 1999) t(y) WHERE year(time) BETWEEN y AND y + 2 GROUP BY 1, 2, 3, 4")
def e12(spark, d):
    return W.sliding_climatology(monthly(spark, d), ["scenario", "gcm"], 1995, 1998, years=3).withColumn("value", r("value", 5))


@query("E13_baseline_anomaly", f"WITH {DAILY} SELECT sim, time, round(value - avg(CASE WHEN year(time) BETWEEN 1995 AND 1997 THEN value END) OVER (PARTITION BY sim), 5) AS anomaly FROM daily")
def e13(spark, d):
    return scan.daily(spark, d).select("sim", "time", r(W.baseline_anomaly(F.col("value"), ["sim"], "time", 1995, 1997), 5).alias("anomaly"))


@query("E14_deseasonalised", f"WITH {DAILY} SELECT sim, time, round(value - avg(value) OVER (PARTITION BY sim, month(time)), 5) AS value FROM daily")
def e14(spark, d):
    return scan.daily(spark, d).select("sim", "time", r(W.deseasonalised(F.col("value"), ["sim"]), 5).alias("value"))


@query("E15_explorer_transforms", f"WITH {DAILY}, a AS (SELECT sim, time, value - avg(CASE WHEN year(time) BETWEEN 1995 AND 1998 THEN value END) OVER (PARTITION BY sim) AS v FROM daily), s AS (SELECT sim, time, CASE WHEN count(v) {over('29 PRECEDING', 'CURRENT ROW')} >= 30 THEN avg(v) {over('29 PRECEDING', 'CURRENT ROW')} END AS v FROM a) SELECT sim, CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) <= 5 THEN 'MAM' WHEN month(time) <= 8 THEN 'JJA' ELSE 'SON' END AS season, round(max(v), 5) AS hi, round(min(v), 5) AS lo FROM s GROUP BY 1, 2")
def e15(spark, d):
    df = scan.daily(spark, d).withColumn("v", W.baseline_anomaly(F.col("value"), ["sim"], "time", 1995, 1998))
    df = df.withColumn("v", W.rolling("mean", F.col("v"), 30, ["sim"]))
    return df.groupBy("sim", N.season(F.col("time")).alias("season")).agg(r(F.max("v"), 5).alias("hi"), r(F.min("v"), 5).alias("lo"))


@query("E16_top_n", f"WITH {DAILY} SELECT sim, month, time, CAST(k AS INT) AS rank FROM (SELECT sim, CAST(month(time) AS INT) AS month, time, row_number() OVER (PARTITION BY sim, month(time) ORDER BY value, time) AS k FROM daily) WHERE k <= 2")
def e16(spark, d):
    df = scan.daily(spark, d).withColumn("month", F.month("time"))
    return W.top_n(df, 2, ["sim", "month"], "value", "time").select("sim", "month", "time", "rank")


@query("E17_day_window_quantiles", f"WITH {HOURLY}, b AS (SELECT sim, CAST(dayofyear(time) AS INT) AS doy, value FROM hourly), x AS (SELECT sim, (doy - 1 + s + 365) % 365 + 1 AS doy, value FROM b, range(-5, 6) t(s)) SELECT sim, CAST(doy AS INT) AS doy, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM x GROUP BY 1, 2")
def e17(spark, d):
    df = scan.hourly(spark, d).withColumn("doy", F.dayofyear("time"))
    q = W.day_window_quantiles(df, ["sim"], [0.25, 0.75], half=5)
    return q.select("sim", "doy", r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("q75"))


@query("E18_cumulative_sum", f"WITH {DAILY} SELECT sim, time, round(sum(rain) OVER (PARTITION BY sim ORDER BY time), 2) AS total FROM daily")
def e18(spark, d):
    w = W.series(["sim"]).rowsBetween(W.Window.unboundedPreceding, 0)
    return scan.daily(spark, d).select("sim", "time", r(F.sum("rain").over(w), 2).alias("total"))


@query("E20_bridge_history", f"WITH {YEARLY}, h AS (SELECT gcm, max(year) AS year, arg_max(value, year) AS value FROM yearly WHERE scenario = 'F' AND year <= 1998 GROUP BY 1) SELECT gcm, year, value FROM yearly WHERE scenario = 'O' AND year > 1998 UNION ALL SELECT gcm, year, value FROM h WHERE gcm IN (SELECT gcm FROM yearly WHERE scenario = 'O' AND year > 1998)")
def e20(spark, d):
    y = yearly(spark, d)
    return subset.with_last_of(y.where("scenario = 'F' and year <= 1998"), y.where("scenario = 'O' and year > 1998"), ["gcm"], "year")


@query("J01_block_maxima", f"WITH {HOURLY}, a AS (SELECT sim, time, CASE WHEN count(value) {over('2 PRECEDING', 'CURRENT ROW')} >= 3 THEN min(value) {over('2 PRECEDING', 'CURRENT ROW')} END AS v FROM hourly), dd AS (SELECT sim, CAST(time AS DATE) AS time, max(v) AS v FROM a GROUP BY 1, 2), g AS (SELECT sim, time, CASE WHEN count(v) {over('1 PRECEDING', 'CURRENT ROW')} >= 2 THEN min(v) {over('1 PRECEDING', 'CURRENT ROW')} END AS v FROM dd) SELECT sim, CAST(year(time) AS INT) AS block, max(v) AS value FROM g WHERE v IS NOT NULL GROUP BY 1, 2")
def j01(spark, d):
    return extremes.block_extremes(scan.hourly(spark, d), ["sim"], "max", duration=3, per_day=True, grouped=2)


BLOCKS = f"{DAILY}, bm AS (SELECT sim, year(time) AS block, max(value) AS value FROM daily WHERE value IS NOT NULL GROUP BY 1, 2)"
GEV = BLOCKS + """, i AS (SELECT sim, value, row_number() OVER (PARTITION BY sim ORDER BY value) - 1 AS i FROM bm),
b AS (SELECT sim, count(*) AS n, avg(value) AS b0, sum(i * value) / (count(*) * (count(*) - 1)) AS b1, sum(i * (i - 1) * value) / (count(*) * (count(*) - 1) * (count(*) - 2)) AS b2 FROM i GROUP BY 1 HAVING count(*) >= 3),
l AS (SELECT *, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3 FROM b), k AS (SELECT *, 2 / (3 + t3) - ln(2) / ln(3) AS c FROM l), s AS (SELECT *, 7.8590 * c + 2.9554 * c * c AS shape FROM k),
g AS (SELECT *, gamma(1 + shape) AS g FROM s), p AS (SELECT *, l2 * shape / ((1 - power(2, -shape)) * g) AS scale FROM g), gev AS (SELECT sim, n, shape, b0 - scale * (1 - g) / shape AS location, scale FROM p)"""


@query("J02_gev_return_values", f"WITH {GEV} SELECT sim, CAST(x AS INT) AS one_in_x, round(location + scale * (1 - power(-ln(1 - 1.0::DOUBLE / x), shape)) / shape, 3) AS return_value FROM gev, (VALUES (2), (10), (50)) t(x)")
def j02(spark, d):
    p = extremes.gev_parameters(extremes.block_extremes(scan.daily(spark, d), ["sim"]), ["sim"])
    return extremes.gev_return_values(p, ["sim"], [2, 10, 50]).withColumn("return_value", r("return_value", 3))


@query("J03_return_probability", f"WITH {GEV}, z AS (SELECT sim, shape, 1 - shape * (95000.0::DOUBLE - location) / scale AS z FROM gev) SELECT sim, round(1 - CASE WHEN z > 0 THEN exp(-power(z, 1 / shape)) WHEN shape > 0 THEN 1.0 ELSE 0.0 END, 6) AS probability FROM z")
def j03(spark, d):
    p = extremes.gev_parameters(extremes.block_extremes(scan.daily(spark, d), ["sim"]), ["sim"])
    return extremes.gev_exceedance(p, ["sim"], 95000.0).select("sim", r("probability").alias("probability"))


@query("J04_fit_with_ks")
def j04(spark, d):
    return extremes.fit_series(extremes.block_extremes(scan.daily(spark, d), ["sim"]), ["sim"], [10, 50], "gumbel")


@query("J05_quantile_delta_mapping")
def j05(spark, d):
    s = scan.scenarios(spark, d)
    obs = s.where("scenario = 'F'").groupBy("gcm", "time").agg(F.avg("value").alias("value"))
    model = s.where("scenario = 'O'").select("gcm", "time", "value")
    return bias.quantile_delta_mapping(obs, model, ["gcm"], (1995, 1997))


@query("J08_two_sample_ks", f"""WITH {DAILY}, u AS (SELECT sim, value AS x, CASE WHEN year(time) <= 1997 THEN 1 ELSE 0 END AS s FROM daily WHERE year(time) <= 1997 OR year(time) >= 1999), st AS (SELECT sim, x, sum(s) AS na, sum(1 - s) AS nb FROM u GROUP BY 1, 2),
g AS (SELECT sim, abs(sum(na) OVER w / sum(na) OVER a - sum(nb) OVER w / sum(nb) OVER a) AS gap, na, nb FROM st WINDOW w AS (PARTITION BY sim ORDER BY x), a AS (PARTITION BY sim)) SELECT sim, round(max(gap), 9) AS d, CAST(sum(na) AS BIGINT) AS n_a, CAST(sum(nb) AS BIGINT) AS n_b FROM g GROUP BY 1""")
def j08(spark, d):
    df = scan.daily(spark, d)
    return extremes.ks_between(df.where(F.year("time") <= 1997), df.where(F.year("time") >= 1999), ["sim"], level=None).select("sim", r("d", 9).alias("d"), "n_a", "n_b")


HOY = f"{HOURLY}, hy AS (SELECT sim, time, value, (dayofyear(time) - 1) * 24 + hour(time) AS hour_of_year FROM hourly)"


@query("J09_standard_year", f"WITH {HOY} SELECT CAST(hour_of_year AS INT) AS hour_of_year, round(quantile_cont(value, 0.9), 6) AS value FROM hy GROUP BY 1")
def j09(spark, d):
    h = scan.hourly(spark, d).withColumn("hour_of_year", N.hour_of_year(F.col("time")))
    return profiles.standard_year(h, [], 0.9).withColumn("value", r("value"))


@query("J10_medoid_year", f"WITH {DAILY}, b AS (SELECT sim, CAST(year(time) AS INT) AS year, month(time) AS m, round(avg(value), 7) AS value FROM daily WHERE year(time) <= 2000 GROUP BY 1, 2, 3), md AS (SELECT sim, m, quantile_cont(value, 0.5) AS q FROM b GROUP BY 1, 2), x AS (SELECT b.sim, b.year, sqrt(sum(power(b.value - md.q, 2))) AS distance FROM b JOIN md ON b.sim = md.sim AND b.m = md.m GROUP BY 1, 2) SELECT sim, arg_min(year, (distance, year)) AS year, round(min(distance), 4) AS distance FROM x GROUP BY 1")
def j10(spark, d):
    m = scan.daily(spark, d).where(F.year("time") <= 2000).groupBy("sim", F.year("time").alias("year"), F.month("time").alias("month")).agg(F.round(F.avg("value"), 7).alias("value"))
    return profiles.medoid_year(m, ["sim"], steps=("month",)).withColumn("distance", r("distance", 4))


FS_BIN = "least(CAST(floor((v - 0.0) / ((hi - 0.0) / 20)) AS INT), 19)"


@query("J12_typical_months", f"""WITH {DAILY}, v AS (SELECT sim, CAST(year(time) AS INT) AS year, CAST(month(time) AS INT) AS month, 'tmax' AS i, tmax AS v, 110000.0::DOUBLE AS hi, 0.4::DOUBLE AS w FROM daily UNION ALL SELECT sim, CAST(year(time) AS INT), CAST(month(time) AS INT), 'tmin', tmin, 110000.0, 0.4 FROM daily UNION ALL SELECT sim, CAST(year(time) AS INT), CAST(month(time) AS INT), 'wind', wind, 0.11, 0.2 FROM daily),
c AS (SELECT sim, year, month, i, w, {FS_BIN} AS bin, count(*) AS c FROM v WHERE v >= 0 AND v <= hi GROUP BY ALL), g AS (SELECT DISTINCT sim, year, month, i, w, CAST(b AS INT) AS bin FROM c, range(20) t(b)),
n AS (SELECT g.*, coalesce(c.c, 0) AS c FROM g LEFT JOIN c USING (sim, year, month, i, bin)), f AS (SELECT *, sum(c) OVER (PARTITION BY sim, i, month, year ORDER BY bin) / sum(c) OVER (PARTITION BY sim, i, month, year) AS f FROM n),
a AS (SELECT sim, i, month, bin, sum(c) AS c FROM n GROUP BY ALL), e AS (SELECT sim, i, month, bin, sum(c) OVER (PARTITION BY sim, i, month ORDER BY bin) / sum(c) OVER (PARTITION BY sim, i, month) AS g FROM a),
s AS (SELECT f.sim, f.i, f.month, f.year, f.w, avg(abs(f.f - e.g)) AS fs FROM f JOIN e USING (sim, i, month, bin) GROUP BY ALL), t AS (SELECT sim, month, year, sum(w * fs) AS score FROM s GROUP BY ALL HAVING year <> 2001),
k AS (SELECT *, row_number() OVER (PARTITION BY sim, month ORDER BY score, year) AS k FROM t) SELECT sim, month, year, round(score, 9) AS score FROM k WHERE k = 1""")
def j12(spark, d):
    edges = {"tmax": (0.0, 110000.0), "tmin": (0.0, 110000.0), "wind": (0.0, 0.11)}
    s = profiles.finkelstein_schafer(scan.daily(spark, d), ["sim"], {"tmax": 0.4, "tmin": 0.4, "wind": 0.2}, edges, skip_years=(2001,))
    return profiles.typical_months(s, ["sim"]).select("sim", "month", "year", r("score", 9).alias("score"))


@query("J13_wind_and_rain", f"WITH {DAILY}, f AS (SELECT sim, CASE WHEN count(rain) {over('2 PRECEDING', 'CURRENT ROW')} >= 3 THEN sum(rain) {over('2 PRECEDING', 'CURRENT ROW')} END > 300 AS wet, wind > 0.07 AS windy, max(CASE WHEN wind > 0.07 THEN 1 ELSE 0 END) {over('2 PRECEDING', 'CURRENT ROW')} = 1 AS spell FROM daily) SELECT sim, round(count(*) FILTER (WHERE wet) / 7.0, 6) AS wet, round(count(*) FILTER (WHERE windy) / 7.0, 6) AS windy, round(count(*) FILTER (WHERE spell) / 7.0, 6) AS windy_spell, round(count(*) FILTER (WHERE wet AND spell) / 7.0, 6) AS compound FROM f GROUP BY 1")
def j13(spark, d):
    got = events.wind_and_rain(scan.daily(spark, d), ["sim"], 300, 0.07, 3, 7.0)
    return got.select("sim", *[r(c).alias(c) for c in ("wet", "windy", "windy_spell", "compound")])


@query("J14_hot_and_calm", f"WITH {DAILY} SELECT sim, round(count(*) FILTER (WHERE tmax > 55000 AND tmin > 20000 AND wind < 0.05) / 7.0, 6) AS rate, round(avg(CASE WHEN tmax > 55000 AND tmin > 20000 AND wind < 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM daily GROUP BY 1")
def j14(spark, d):
    return events.hot_and_calm(scan.daily(spark, d), ["sim"], 55000, 20000, 0.05, 7.0).select("sim", r("rate").alias("rate"), r("share").alias("share"))


@query("J16_climate_state", f"""WITH {MONTHLY}, c AS (SELECT scenario, gcm, month(time) AS m, quantile_cont(value, 0.5) AS clim FROM monthly WHERE year(time) BETWEEN 1995 AND 1997 GROUP BY 1, 2, 3), a AS (SELECT s.scenario, s.gcm, s.time, s.value - c.clim AS anomaly FROM monthly s JOIN c ON s.scenario = c.scenario AND s.gcm = c.gcm AND month(s.time) = c.m),
w AS (SELECT *, CASE WHEN count(*) OVER x >= 6 THEN quantile_cont(anomaly, 0.5) OVER x END AS smooth FROM a WINDOW x AS (PARTITION BY scenario, gcm ORDER BY time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
l AS (SELECT scenario, gcm, quantile_cont(smooth, 0.25) AS lo, quantile_cont(smooth, 0.75) AS hi FROM w WHERE year(time) BETWEEN 1995 AND 1997 GROUP BY 1, 2),
b AS (SELECT w.*, CASE WHEN smooth > hi THEN 1 WHEN smooth < lo THEN -1 ELSE 0 END AS s FROM w JOIN l USING (scenario, gcm)),
r AS (SELECT *, row_number() OVER (PARTITION BY scenario, gcm ORDER BY time) - row_number() OVER (PARTITION BY scenario, gcm, s ORDER BY time) AS g FROM b)
SELECT scenario, gcm, time, round(smooth, 5) AS smooth, CASE WHEN count(*) OVER (PARTITION BY scenario, gcm, s, g) >= 3 THEN s ELSE 0 END AS hit FROM r""")
def j16(spark, d):
    got = events.climate_state(monthly(spark, d), ["scenario", "gcm"], (1995, 1997), 6, 3)
    return got.select("scenario", "gcm", "time", r("smooth", 5).alias("smooth"), "hit")


@query("J17_event_finder", f"WITH {DAILY}, t AS (SELECT sim, quantile_cont(value, 0.9) AS q FROM daily WHERE year(time) <= 1997 GROUP BY 1), f AS (SELECT d.sim, d.time, sum(CASE WHEN d.value > t.q THEN 1 ELSE 0 END) OVER (PARTITION BY d.sim ORDER BY d.time ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) >= 2 AS hit FROM daily d JOIN t ON d.sim = t.sim) SELECT sim, CAST(year(time) AS INT) AS year, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS events FROM f GROUP BY 1, 2")
def j17(spark, d):
    df = scan.daily(spark, d)
    limit = df.where(F.year("time") <= 1997).groupBy("sim").agg(F.percentile("value", F.lit(0.9)).alias("threshold"))
    return events.find_events(df, ["sim"], limit, ">", 2).groupBy("sim", F.year("time").alias("year")).agg(F.count_if(F.col("hit") == 1).alias("events"))


@query("J18_climate_signal", f"WITH {YEARLY}, l AS (SELECT scenario, gcm, value, CASE WHEN year <= 1997 THEN 1.2 WHEN year >= 1999 THEN 2.0 END AS wl FROM yearly) SELECT scenario, gcm, round(100.0 * (avg(value) FILTER (WHERE wl = 2.0) - avg(value) FILTER (WHERE wl = 1.2)) / (avg(value) FILTER (WHERE wl = 1.2)), 6) AS signal FROM l GROUP BY 1, 2")
def j18(spark, d):
    y = yearly(spark, d).withColumn("warming_level", F.when(F.col("year") <= 1997, 1.2).when(F.col("year") >= 1999, 2.0))
    return events.climate_signal(y, ["scenario", "gcm"], 1.2, 2.0, relative=True).select("scenario", "gcm", r("signal").alias("signal"))


@query("J19_variance_parts", f"""WITH {YEARLY}, s AS (SELECT scenario, gcm, year, CASE WHEN count(*) OVER x >= 3 THEN avg(value) OVER x END AS v FROM yearly WINDOW x AS (PARTITION BY scenario, gcm ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), f AS (SELECT * FROM s WHERE v IS NOT NULL),
i AS (SELECT avg(x) AS internal FROM (SELECT var_pop(v) AS x FROM f GROUP BY scenario, year)), m AS (SELECT year, avg(x) AS model FROM (SELECT scenario, year, var_pop(v) AS x FROM f GROUP BY 1, 2) GROUP BY 1), c AS (SELECT year, var_pop(x) AS sv FROM (SELECT scenario, year, avg(v) AS x FROM f GROUP BY 1, 2) GROUP BY 1)
SELECT year, round(internal / (internal + model + sv), 7) AS internal_fraction, round(model / (internal + model + sv), 7) AS model_fraction, round(sv / (internal + model + sv), 7) AS scenario_var_fraction FROM m JOIN c USING (year), i""")
def j19(spark, d):
    y = yearly(spark, d).withColumn("sim", F.concat("scenario", "gcm"))
    got = ensemble.variance_parts(y, smooth=3)
    return got.select("year", *[r(f"{c}_fraction", 7).alias(f"{c}_fraction") for c in ("internal", "model", "scenario_var")])


@query("J20_scenario_against_model", f"WITH {YEARLY}, b AS (SELECT year, var_samp(m) AS s, avg(v) AS m FROM (SELECT scenario, year, avg(value) AS m, var_pop(value) AS v FROM yearly GROUP BY 1, 2) GROUP BY 1), c AS (SELECT year, CASE WHEN count(s) OVER x >= 2 THEN avg(s) OVER x END AS s, CASE WHEN count(m) OVER x >= 2 THEN avg(m) OVER x END AS m FROM b WINDOW x AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)) SELECT year, round(s / (s + m), 7) AS fraction FROM c")
def j20(spark, d):
    y = yearly(spark, d).withColumnRenamed("gcm", "sim")
    return ensemble.scenario_against_model(y, smooth=4, min_periods=2).select("year", r("fraction", 7).alias("fraction"))


@query("J21_year_at_level", f"WITH {YEARLY}, t AS (SELECT scenario, year, quantile_cont(value, 0.05) AS p5, avg(value) AS mean, quantile_cont(value, 0.95) AS p95 FROM yearly GROUP BY 1, 2) SELECT scenario, min(CASE WHEN mean > 151000 THEN year END) AS best, min(CASE WHEN p95 > 151000 THEN year END) AS earliest, min(CASE WHEN p5 > 151000 THEN year END) AS latest FROM t GROUP BY 1")
def j21(spark, d):
    t = yearly(spark, d).groupBy("scenario", "year").agg(F.percentile("value", F.lit(0.05)).alias("p5"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.95)).alias("p95"))
    return warming.year_at_level(t, 151000.0)


@query("J22_simulations_at_level", f"WITH {YEARLY}, c AS (SELECT scenario || gcm AS sim, min(CASE WHEN value > 151000 THEN year END) AS crossing FROM yearly GROUP BY 1) SELECT crossing, count(*) AS simulations FROM c WHERE crossing IS NOT NULL GROUP BY 1")
def j22(spark, d):
    y = yearly(spark, d).withColumn("sim", F.concat("scenario", "gcm"))
    return warming.simulations_at(warming.crossings(y, [151000.0], ["sim"]), level=151000.0)


@query("J24_degree_days", f"WITH {DAILY} SELECT sim, round(sum(greatest(35000 - (tmax + tmin) / 2, 0)) / 1000, 3) AS hdd, round(sum(greatest((tmax + tmin) / 2 - 42000, 0)) / 1000, 3) AS cdd FROM daily GROUP BY 1")
def j24(spark, d):
    h, c = indices.degree_days(F.col("tmax"), F.col("tmin"), 35000, 42000)
    return scan.daily(spark, d).groupBy("sim").agg(r(F.sum(h) / 1000, 3).alias("hdd"), r(F.sum(c) / 1000, 3).alias("cdd"))


@query("J25_degree_hours", f"WITH {HOURLY} SELECT sim, CAST(time AS DATE) AS day, count(*) FILTER (WHERE value < 30) AS hdh, count(*) FILTER (WHERE value > 60) AS cdh FROM hourly GROUP BY 1, 2")
def j25(spark, d):
    return indices.degree_hours(scan.hourly(spark, d), ["sim"], 30, 60)


@query("J26_exceedance_counts", f"WITH {DAILY}, k AS (SELECT sim, time, sum(CASE WHEN value > 38000 THEN 1 ELSE 0 END) {over('1 PRECEDING', 'CURRENT ROW')} >= 2 AS hit FROM daily), c AS (SELECT sim, CAST(date_trunc('year', time) AS DATE) AS period, count(*) FILTER (WHERE hit) AS count FROM k GROUP BY 1, 2) SELECT sim, period, count, round(CASE WHEN count(*) OVER x >= 3 THEN avg(count) OVER x END, 6) AS smoothed FROM c WINDOW x AS (PARTITION BY sim ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def j26(spark, d):
    return events.exceedance_counts(scan.daily(spark, d), ["sim"], 38000, ">", 2, "year", 3).withColumn("smoothed", r("smoothed"))


@query("J27_profile_degree_days", f"WITH {HOY}, p AS (SELECT hour_of_year, quantile_cont(value, 0.5) AS v FROM hy GROUP BY 1), dd AS (SELECT floor(hour_of_year / 24) AS day, avg(v) AS m FROM p GROUP BY 1) SELECT round(sum(greatest(m - 40, 0)), 5) AS cdd FROM dd")
def j27(spark, d):
    h = scan.hourly(spark, d).withColumn("hour_of_year", N.hour_of_year(F.col("time")))
    return profiles.degree_days_of_profile(profiles.standard_year(h, []), [], 40.0).withColumn("cdd", r("cdd", 5))


@query("J29_effective_temperature", f"WITH {DAILY}, s AS (SELECT sim, time, tmax / 1000 AS x, tmin / 1000 AS n FROM daily) SELECT sim, time, round(0.7 * x + 0.003 * n * lag(x) OVER w + 0.002 * lag(n) OVER w * lag(x, 2) OVER w, 6) AS teff FROM s WINDOW w AS (PARTITION BY sim ORDER BY time)")
def j29(spark, d):
    df = scan.daily(spark, d).withColumn("tmax", F.col("tmax") / 1000).withColumn("tmin", F.col("tmin") / 1000)
    return indices.effective_temperature(df, ["sim"]).select("sim", "time", r("teff").alias("teff"))


@query("J30_geostrophic_wind", f"""WITH {GRID}, g AS (SELECT cell % 10 AS y, floor(cell / 10) % 10 AS x, min(lat) AS lat, round(avg(value) / 10, 7) AS z FROM grid GROUP BY 1, 2),
q AS (SELECT *, lead(x) OVER a - lag(x) OVER a AS sx, lead(y) OVER b - lag(y) OVER b AS sy, (lead(z) OVER a - lag(z) OVER a) / 100000.0 AS dx, (lead(z) OVER b - lag(z) OVER b) / 100000.0 AS dy FROM g WINDOW a AS (PARTITION BY y ORDER BY x), b AS (PARTITION BY x ORDER BY y))
SELECT CAST(x AS BIGINT) AS x, y, round(-9.80665 / (2 * 7.2921e-5 * sin(radians(lat))) * dy, 5) AS u, round(9.80665 / (2 * 7.2921e-5 * sin(radians(lat))) * dx, 5) AS v FROM q WHERE sx = 2 AND sy = 2""")
def j30(spark, d):
    g = scan.grid(spark, d).groupBy((F.col("cell") % 10).alias("y"), (F.floor(F.col("cell") / 10) % 10).alias("x")).agg(F.min("lat").alias("lat"), F.round(F.avg("value") / 10, 7).alias("value"))
    return indices.geostrophic_wind(g, [], 50000.0).select("x", "y", r("u", 5).alias("u"), r("v", 5).alias("v"))


@query("J32_point_differences", f"WITH {GRID} SELECT sim, year, round(max(CASE WHEN cell = 3 THEN value END) - max(CASE WHEN cell = 7 THEN value END), 6) AS difference, round((max(CASE WHEN cell = 3 THEN value END) + max(CASE WHEN cell = 7 THEN value END)) / 2, 6) AS mean FROM grid WHERE cell IN (3, 7) GROUP BY 1, 2")
def j32(spark, d):
    p = indices.point_difference(scan.grid(spark, d), ["sim", "year"], "cell", 3, 7)
    return p.select("sim", "year", r("difference").alias("difference"), r("mean").alias("mean"))


@query("J34_palmer_drought")
def j34(spark, d):
    m = monthly(spark, d).withColumn("precip", F.col("value") / 50000).withColumn("pet", 2.0 + F.sin(F.month("time") * 0.52))
    return indices.palmer(m, ["scenario", "gcm"], 6.0, (1995, 2000)).select("scenario", "gcm", "time", "z_index", "pdsi")


@query("J35_standardised_index")
def j35(spark, d):
    return indices.standardised_index(monthly(spark, d), ["scenario", "gcm"], (1995, 2000)).select("scenario", "gcm", "time", "index")


@query("J37_kernel_density", f"WITH {YEARLY}, h AS (SELECT scenario, stddev_samp(value) * 0.5 AS h FROM yearly GROUP BY 1), g AS (SELECT y.scenario, i, sum(exp(-0.5 * power((130000 + i * 1000.0 - y.value) / h.h, 2))) AS d FROM yearly y JOIN h USING (scenario), range(0, 41) t(i) GROUP BY 1, 2) SELECT scenario, CAST(i AS INT) AS i, round(d / max(d) OVER (PARTITION BY scenario), 6) AS density FROM g")
def j37(spark, d):
    return ensemble.density(yearly(spark, d), ["scenario"], 130000.0, 170000.0, points=41).select("scenario", "i", r("density").alias("density"))


@query("J38_monthly_basin", f"WITH {DAILY} SELECT sim, CAST(date_trunc('month', time) AS DATE) AS month, round(sum(rain), 3) AS rain, round(avg(tmax), 5) AS tmax, round(avg(tmin), 5) AS tmin FROM daily GROUP BY 1, 2")
def j38(spark, d):
    m = basins.monthly_basin(scan.daily(spark, d), ["sim"], ["rain"], ["tmax", "tmin"])
    return m.select("sim", "month", r("rain", 3).alias("rain"), r("tmax", 5).alias("tmax"), r("tmin", 5).alias("tmin"))


@query("J39_region_mask", f"WITH {GRID}, c AS (SELECT DISTINCT cell, lat, lon FROM grid) SELECT cell, CASE WHEN lat > 32.2 AND lat < 34.2 AND lon > -120.2 AND lon < -117.8 THEN 1 END AS region_id FROM c")
def j39(spark, d):
    polygons = scan.literal(spark, [(1, [(-120.2, 32.2), (-117.8, 32.2), (-117.8, 34.2), (-120.2, 34.2)])], "region_id int, ring array<struct<lon: double, lat: double>>")
    return geo.region_mask(scan.grid(spark, d).select("cell", "lat", "lon").distinct(), polygons, "cell").select("cell", "region_id")


@query("J41_around_extremes", f"WITH {HOURLY}, p AS (SELECT sim, arg_min(time, (-value, time)) AS peak FROM hourly GROUP BY 1) SELECT sim, (epoch_us(time) - epoch_us(peak)) / 3.6e9 AS hours_from_peak, value FROM hourly JOIN p USING (sim) WHERE abs((epoch_us(time) - epoch_us(peak)) / 3.6e9) <= 72")
def j41(spark, d):
    return indices.around_extremes(scan.hourly(spark, d), ["sim"]).select("sim", "hours_from_peak", "value")


@query("J42_dewpoint_inconsistency", f"WITH {DAILY} SELECT month, round(avg(p), 6) AS pct FROM (SELECT sim, CAST(month(time) AS INT) AS month, 100.0 * count(*) FILTER (WHERE tmin > value * 0.9) / count(*) AS p FROM daily GROUP BY 1, 2) GROUP BY 1")
def j42(spark, d):
    df = scan.daily(spark, d).withColumn("t", F.col("value") * 0.9).withColumn("td", F.col("tmin"))
    return indices.inconsistent_dewpoint(df, ["sim"]).withColumn("pct", r("pct"))


@query("J44_cell_outlines", f"WITH {GRID}, c AS (SELECT DISTINCT cell, lat, lon FROM grid WHERE cell < 100) SELECT cell, lon - coalesce(lon - lag(lon) OVER a, lead(lon) OVER a - lon) / 2 AS west, lon + coalesce(lead(lon) OVER a - lon, lon - lag(lon) OVER a) / 2 AS east, lat - coalesce(lat - lag(lat) OVER b, lead(lat) OVER b - lat) / 2 AS south, lat + coalesce(lead(lat) OVER b - lat, lat - lag(lat) OVER b) / 2 AS north FROM c WINDOW a AS (PARTITION BY lat ORDER BY lon), b AS (PARTITION BY lon ORDER BY lat)")
def j44(spark, d):
    c = scan.grid(spark, d).select("cell", "lat", "lon").distinct()
    return geo.cell_outlines(c, "lon", "lat").select("cell", "west", "east", "south", "north")


def live(spark, d):
    """The events table as a stream with timestamps."""
    df = stream.read(spark, d, scan.table(spark, d, "events").schema, "events.parquet")
    return df.withColumn("sim", F.col("event_type")).withColumn("ts", F.col("ts").cast("timestamp"))


def replayed(spark, df):
    return stream.replay(spark, df, f"stream_{uuid.uuid4().hex}", "complete")


@query("L01_stream_daily", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type AS sim, count(value) AS n, round(sum(value), 3) AS total, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def l01(spark, d):
    return replayed(spark, stream.resample(live(spark, d), ["sim"], late="60 days")).withColumn("total", r("total", 3))


@query("L02_stream_sliding", "SELECT CAST(date_trunc('day', ts) - to_days(CAST(k AS INT)) AS TIMESTAMP) AS start, event_type AS sim, count(value) AS n, round(sum(value), 3) AS total FROM events, range(3) t(k) GROUP BY 1, 2")
def l02(spark, d):
    return replayed(spark, stream.rolling(live(spark, d), ["sim"], late="60 days")).withColumn("total", r("total", 3))


@query("L03_stream_sessions", "WITH g AS (SELECT event_type AS sim, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT sim, ts, sum(new) OVER (PARTITION BY sim ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT sim, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT sim, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1")
def l03(spark, d):
    return replayed(spark, stream.sessions(live(spark, d), ["sim"], "1 hour", late="60 days")).groupBy("sim").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("L04_stream_counts", "SELECT event_type AS sim, count(*) FILTER (WHERE value > 50) AS hits, count(*) AS n FROM events GROUP BY 1")
def l04(spark, d):
    return replayed(spark, stream.exceedances(live(spark, d), ["sim"], 50.0))
