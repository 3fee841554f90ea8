"""Queries for streams as they run at scale: rows are appended to files once the watermark has made them final."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import series as stream
from .base import query
from .series_queries import live
from .subset_queries import scratch

LATE = "1 hour"
FINAL = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def appended(spark, df):
    return stream.append(spark, df, scratch(spark))


@query("L05_append_daily", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type AS sim, count(value) AS n, round(sum(value), 3) AS total, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= {FINAL}")
def l05(spark, d):
    return appended(spark, stream.resample(live(spark, d), ["sim"], late=LATE)).withColumn("total", F.round("total", 3))


@query("L06_append_complete_sliding", f"SELECT start, sim, n, round(total, 3) AS total FROM (SELECT CAST(date_trunc('day', ts) - to_days(CAST(k AS INT)) AS TIMESTAMP) AS start, event_type AS sim, count(value) AS n, sum(value) AS total FROM events, range(3) t(k) GROUP BY 1, 2) WHERE n >= 20 AND start + INTERVAL 3 DAY <= {FINAL}")
def l06(spark, d):
    return appended(spark, stream.rolling(live(spark, d), ["sim"], late=LATE, needed=20)).withColumn("total", F.round("total", 3))


@query("L07_append_sessions", f"""WITH g AS (SELECT event_type AS sim, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
 s AS (SELECT sim, ts, sum(new) OVER (PARTITION BY sim ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", sim, count(*) AS n FROM s GROUP BY sim, k HAVING max(ts) + INTERVAL 1 HOUR <= {FINAL}""")
def l07(spark, d):
    return appended(spark, stream.sessions(live(spark, d), ["sim"], "1 hour", late=LATE))


@query("L08_append_runs", """WITH g AS (SELECT event_type AS sim, ts, value > 20 AS hot, row_number() OVER w - count(*) FILTER (WHERE value > 20) OVER (PARTITION BY event_type ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS k,
  max(CASE WHEN value > 20 THEN NULL ELSE ts END) OVER (PARTITION BY event_type) AS last_cool FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, value))
 SELECT sim, min(ts) AS start, max(ts) AS "end", count(*) AS length FROM g WHERE hot GROUP BY sim, k, last_cool HAVING count(*) >= 3 AND max(ts) < last_cool""")
def l08(spark, d):
    return appended(spark, stream.running_extremes(live(spark, d).select("sim", "ts", "value"), "sim", 3, 20.0))


@query("L09_append_starts", """SELECT sim, start FROM (SELECT event_type AS sim, ts AS start, count(*) FILTER (WHERE value > 20) OVER (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS hits FROM events) WHERE hits = 3""")
def l09(spark, d):
    return appended(spark, stream.running_starts(live(spark, d).select("sim", "ts", "value"), "sim", 3, 20.0))
