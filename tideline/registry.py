"""Queries by name, and for each the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import anomaly, changefeed, heavykeys, quotient, regrid

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as the query of its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Problem 1: messages delivered more than once.


@query("""
SELECT seq FROM (
  SELECT seq, min(seq) OVER (PARTITION BY address, time) AS earliest
  FROM simple_points WHERE address IS NOT NULL AND time IS NOT NULL)
WHERE seq > earliest
UNION ALL
SELECT seq FROM (
  SELECT seq, min(seq) OVER (PARTITION BY address, time) AS earliest
  FROM extended_points WHERE address IS NOT NULL AND time IS NOT NULL)
WHERE seq > earliest
""")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of both point tables that repeat an earlier delivery."""
    tables = (table(spark, sf, t).select("address", "time", "seq") for t in ("simple_points", "extended_points"))
    simple, extended = (quotient.redelivered(t).filter(F.col("seq").isNotNull()).select("seq") for t in tables)
    return simple.unionAll(extended)


# Problem 2: a change feed.


@query("""
SELECT address, time, change_seq FROM (
  SELECT address, time, change_seq, lower(trim(op)) AS kind,
         row_number() OVER (PARTITION BY address, time ORDER BY change_seq DESC) AS n
  FROM point_changes
  WHERE address IS NOT NULL AND time IS NOT NULL AND change_seq IS NOT NULL
    AND lower(trim(op)) IN ('i', 'ins', 'insert', 'u', 'upd', 'update', 'd', 'del', 'delete'))
WHERE n = 1 AND kind NOT IN ('d', 'del', 'delete')
""")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The rebuilt table with the change behind each row."""
    return changefeed.current_rows(table(spark, sf, "point_changes")).select("address", "time", "change_seq")


# Problem 3: irregular readings onto a regular grid.


@query("""
WITH w AS (SELECT DISTINCT window_id, address, start_time, step_ns, n_slots FROM reading_windows
           WHERE step_ns > 0 AND n_slots > 0 AND address IS NOT NULL AND start_time IS NOT NULL),
g AS (SELECT *, unnest(range(n_slots)) AS slot FROM w),
r AS (SELECT w.*, (p.time - w.start_time) // w.step_ns AS own, ((p.time - w.start_time) % w.step_ns)::DOUBLE / w.step_ns - 0.5 AS u, p.payload::DOUBLE AS y
      FROM w JOIN simple_points p ON p.address = w.address AND p.time >= w.start_time AND p.time < w.start_time + w.step_ns * w.n_slots
      WHERE p.payload IS NOT NULL),
k AS (SELECT *, greatest(0, 1 - d * d / 2.25) AS w FROM (SELECT address, start_time, own - j AS slot, u + j AS d, y, j FROM r CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j))),
s AS (SELECT address, start_time, slot, count(*) FILTER (j = 0) AS readings, sum(w) AS w, sum(w * d) AS wd, sum(w * d * d) AS wdd,
             sum(w * y) AS wy, sum(w * d * y) AS wdy, sum(w * w) AS ww FROM k GROUP BY ALL),
e AS (SELECT g.*, coalesce(readings, 0) AS readings, CASE WHEN w > 1e-9 THEN w * w / ww ELSE 0 END AS support,
             CASE WHEN w * wdd - wd * wd <= 1e-6 * w * w * 2.25 THEN wy / w ELSE (wdd * wy - wd * wdy) / (w * wdd - wd * wd) END AS estimate
      FROM g LEFT JOIN s USING (address, start_time, slot))
SELECT window_id, address, slot, start_time + slot * step_ns AS slot_time, readings, round(support, 3) AS support,
       CASE WHEN support >= 1.5 THEN CASE WHEN abs(estimate) < 1e9 THEN round(estimate, 3) ELSE round(estimate / 1e9) * 1e9 END END AS value, support < 1.5 AS missing FROM e
""")
def p3_method(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid: value where the support suffices, else a missing mark, for every slot.

    Rounded for the comparison with SQL: sums of 64-bit floats beside payloads near 2**62 are good to some thousands.
    """
    grid = regrid.regular_grid(table(spark, sf, "simple_points"), table(spark, sf, "reading_windows"))
    value = F.when(F.abs("value") < 1e9, F.round("value", 3)).otherwise(F.round(F.col("value") / 1e9) * 1e9)
    return grid.withColumn("support", F.round("support", 3)).withColumn("value", value)


@query("""
WITH w AS (SELECT DISTINCT window_id, address, start_time, step_ns, n_slots FROM reading_windows WHERE step_ns > 0 AND n_slots > 0),
s AS (SELECT window_id, address, start_time + k * step_ns AS slot_time
      FROM (SELECT *, unnest(range(n_slots)) AS k FROM w WHERE address IS NOT NULL AND start_time IS NOT NULL)),
f AS (SELECT DISTINCT w.window_id, w.start_time + ((p.time - w.start_time) // w.step_ns) * w.step_ns AS slot_time
      FROM w JOIN simple_points p ON p.address = w.address AND p.time >= w.start_time AND p.time < w.start_time + w.step_ns * w.n_slots
      WHERE p.payload IS NOT NULL)
SELECT s.address, s.slot_time FROM s ANTI JOIN f USING (window_id, slot_time)
""")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of the regression's grid without a reading of their own."""
    grid = regrid.regular_grid(table(spark, sf, "simple_points"), table(spark, sf, "reading_windows"))
    return grid.filter(F.col("readings") == 0).select("address", "slot_time")


# Problem 4: a few keys holding most records.


@query("""
SELECT address FROM simple_points WHERE address IS NOT NULL GROUP BY address
HAVING count(*) >= 0.03 * (SELECT count(address) FROM simple_points)
""")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses with at least 3 % of the rows."""
    return heavykeys.heavy_keys(table(spark, sf, "simple_points"), 0.03).select("address")


@query("""
WITH u AS (
  SELECT address, payload, CASE WHEN time < 0 THEN time::HUGEINT + 18446744073709551616 ELSE time::HUGEINT END AS t
  FROM simple_points WHERE address IS NOT NULL),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY address ORDER BY t NULLS FIRST) AS gap FROM u),
r AS (
  SELECT address, count(*) AS points, min(t) AS f, max(t) AS l, max(gap) AS gap, count(payload) AS payloads,
         CAST(sum(payload) AS VARCHAR) AS payload_sum, min(payload) AS lowest, max(payload) AS highest
  FROM g GROUP BY address)
SELECT address, points,
       CAST(CASE WHEN f >= 9223372036854775808 THEN f - 18446744073709551616 ELSE f END AS BIGINT) AS first_time,
       CAST(CASE WHEN l >= 9223372036854775808 THEN l - 18446744073709551616 ELSE l END AS BIGINT) AS last_time,
       CAST(least(gap, 9223372036854775807) AS BIGINT) AS widest_gap, payloads, payload_sum, lowest, highest
FROM r
""")
def p4_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Exact statistics of every address, times in unsigned order."""
    stats = heavykeys.key_statistics(table(spark, sf, "simple_points"))
    return stats.select("address", "points", "first_time", "last_time", "widest_gap", "payloads", F.col("payload_sum").cast("string").alias("payload_sum"), "lowest", "highest")


# Problem 5: implausible spikes in measurements.


@query()
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Implausible readings."""
    tables = (table(spark, sf, t) for t in ("simple_points", "reading_windows", "units"))
    return anomaly.implausible(*tables, only_found=True).select("seq")


@query()
def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading with its score, deviation and run, and the reason if it is implausible."""
    return anomaly.implausible(*(table(spark, sf, t) for t in ("simple_points", "reading_windows", "units")))
