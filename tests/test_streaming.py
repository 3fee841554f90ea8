from pyspark.sql import functions as F

from tephra.streaming import series

EVENTS = "/root/testdata/sf0.001"


def source(spark):
    batch = spark.read.parquet(f"{EVENTS}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    schema = spark.read.parquet(f"{EVENTS}/events.parquet").schema
    return batch, series.read(spark, EVENTS, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_daily_stream_equals_batch(spark):
    batch, live = source(spark)
    got = series.replay(spark, series.resample(live, ["event_type"], late="90 days"), "t_daily", "complete")
    want = batch.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("value").alias("n"))
    assert {(r["start"], r["event_type"], r["n"]) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_sliding_and_sessions(spark):
    batch, live = source(spark)
    got = series.replay(spark, series.rolling(live, ["event_type"], late="90 days"), "t_roll", "complete")
    assert got.agg(F.sum("n")).first()[0] == 3 * batch.count()
    live = source(spark)[1]
    s = series.replay(spark, series.sessions(live, ["event_type"], "6 hours", late="90 days"), "t_sess", "complete")
    assert s.agg(F.sum("n")).first()[0] == batch.count()


def test_counts_update(spark):
    batch, live = source(spark)
    got = {r["event_type"]: r["hits"] for r in series.replay(spark, series.exceedances(live, ["event_type"], 50.0), "t_count", "complete").collect()}
    want = {r["event_type"]: r["n"] for r in batch.where("value > 50").groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_stateful_runs_equal_a_scan(spark):
    batch, live = source(spark)
    got = {tuple(r)[:1] + tuple(r)[3:] + (r["start"],) for r in series.replay(spark, series.running_extremes(live.select("event_type", "ts", "value"), "event_type", 2, 60.0), "t_runs").collect()}
    want = set()
    for kind in {r[0] for r in batch.select("event_type").distinct().collect()}:
        run = []
        for r in [*batch.where(F.col("event_type") == kind).orderBy("ts").collect(), None]:
            if r is not None and r["value"] > 60:
                run.append(r["ts"])
                continue
            if len(run) >= 2 and r is not None:
                want.add((kind, len(run), run[0]))
            run = []
    assert got == want


def dropped_in(spark, folder, name, rows):
    """One more file in a stream's folder, of (sim, hour of 2024, value)."""
    made = spark.createDataFrame(rows, "sim string, h int, value double").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, h)")).drop("h")
    made.coalesce(1).write.parquet(f"{folder}/{name}")
    return series.read(spark, f"{folder}/*", made.schema)


def test_appended_windows_go_on_from_the_checkpoint_and_drop_late_rows(spark, tmp_path):
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    daily = lambda s: series.resample(s, ["sim"], late="1 hour")
    hours = lambda df: {(r["start"].day, r["n"], r["total"]) for r in df.collect()}
    first = dropped_in(spark, where, "a", [("x", 1, 1.0), ("x", 2, None), ("x", 30, 5.0)])
    assert hours(series.append(spark, daily(first), out)) == {(1, 1, 1.0)}  # the second day is still open
    second = dropped_in(spark, where, "b", [("x", 3, 100.0), ("x", 31, 7.0), ("x", 60, 9.0)])
    assert hours(series.append(spark, daily(second), out)) == {(1, 1, 1.0), (2, 2, 12.0)}  # hour 3 came after its day was final


def test_complete_windows_only(spark, tmp_path):
    live = dropped_in(spark, str(tmp_path / "in"), "a", [("x", 24 * d, 1.0) for d in range(5)])
    got = series.append(spark, series.rolling(live, ["sim"], needed=3), str(tmp_path / "out")).collect()
    assert {r["start"].day for r in got} == {1} and got[0]["total"] == 3.0  # 1 to 3 January; the window to the 4th ends after the watermark


def test_runs_and_starts_over_several_batches(spark, tmp_path):
    where, run_out, start_out = str(tmp_path / "in"), str(tmp_path / "runs"), str(tmp_path / "starts")
    both = lambda s: (series.append(spark, series.running_extremes(s, "sim", 3, 0.5), run_out), series.append(spark, series.running_starts(s, "sim", 3, 0.5), start_out))
    runs, starts = both(dropped_in(spark, where, "a", [("x", 0, 1.0), ("x", 1, 1.0), ("y", 0, None), ("y", 1, 1.0)]))
    assert runs.count() == 0 and starts.count() == 0
    runs, starts = both(dropped_in(spark, where, "b", [("x", 3, 1.0), ("x", 2, 1.0), ("x", 0, 0.0), ("y", 2, 1.0), ("y", 3, None)]))  # the row of hour 0 is late
    assert runs.count() == 0 and sorted((r["sim"], r["start"].hour) for r in starts.collect()) == [("x", 0), ("x", 1)]
    runs, starts = both(dropped_in(spark, where, "c", [("x", 4, 0.0), ("x", 5, 1.0)]))
    assert [(r["sim"], r["start"].hour, r["end"].hour, r["length"]) for r in runs.collect()] == [("x", 0, 3, 4)]
    assert starts.count() == 2
