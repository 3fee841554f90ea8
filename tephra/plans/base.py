"""Registry of queries with their SQL, and the SQL of the test tables' climate roles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}

DAILY = """daily AS (SELECT l_returnflag || l_linestatus AS sim, CAST(l_shipdate AS DATE) AS time, round(avg(l_extendedprice), 7) AS value,
 sum(l_quantity) AS rain, round(avg(l_discount), 7) AS wind, max(l_extendedprice) AS tmax, min(l_extendedprice) AS tmin FROM lineitem GROUP BY 1, 2)"""
HOURLY = "hourly AS (SELECT event_type AS sim, date_trunc('hour', ts) AS time, round(avg(value), 7) AS value FROM events GROUP BY 1, 2)"
SCEN = "scen AS (SELECT o_orderstatus AS scenario, o_orderpriority AS gcm, CAST(o_orderdate AS DATE) AS time, round(avg(o_totalprice), 7) AS value FROM orders GROUP BY 1, 2, 3)"
GRID = """grid AS (SELECT l_returnflag || l_linestatus AS sim, l_suppkey AS cell, CAST(year(l_shipdate) AS INT) AS year, round(avg(l_extendedprice), 7) AS value,
 32.0::DOUBLE + l_suppkey % 10 * 0.5::DOUBLE AS lat, -120.0::DOUBLE + floor(l_suppkey / 10) % 10 * 0.5::DOUBLE AS lon FROM lineitem GROUP BY 1, 2, 3)"""
YEARLY = SCEN + ", yearly AS (SELECT scenario, gcm, CAST(year(time) AS INT) AS year, round(avg(value), 7) AS value FROM scen GROUP BY 1, 2, 3)"
MONTHLY = SCEN + ", monthly AS (SELECT scenario, gcm, CAST(date_trunc('month', time) AS DATE) AS time, round(avg(value), 7) AS value FROM scen GROUP BY 1, 2, 3)"


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put
