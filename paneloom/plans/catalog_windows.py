"""Queries of ranks, rolling windows and series operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.operators import rolling, spectral, windows
from paneloom.operators.relational import ordinal

from .registry import query
from .tables import table


@query("w1_argsort", "SELECT row_number() OVER (ORDER BY value DESC, event_id) - 1 AS place, event_id FROM events WHERE value > 10")
def w1(spark, d):
    gaps = table(spark, d, "events").select("event_id", F.when(F.col("value") > 10, F.col("value")).alias("v"))
    return windows.argsort(gaps, "v", "event_id", reverse=True)


_GAP = "CASE WHEN value > 10 THEN value END"


@query("w2_rank", f"SELECT event_id, CASE WHEN v IS NULL THEN -1 ELSE row_number() OVER (ORDER BY v NULLS LAST, event_id) - 1 END AS rank FROM (SELECT event_id, {_GAP} AS v FROM events)")
def w2(spark, d):
    gaps = table(spark, d, "events").select("event_id", F.when(F.col("value") > 10, F.col("value")).alias("v"))
    return windows.rank(gaps, "v", "event_id").select("event_id", "rank")


@query("w2_rank_axis", f"SELECT event_id, CASE WHEN v IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY event_type ORDER BY v DESC NULLS LAST, event_id) - 1 END AS rank FROM (SELECT event_id, event_type, {_GAP} AS v FROM events)")
def w2a(spark, d):
    gaps = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("value") > 10, F.col("value")).alias("v"))
    return windows.rank(gaps, "v", "event_id", by=["event_type"], reverse=True).select("event_id", "rank")


@query("w3_percentile_rank", f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(row_number() OVER (ORDER BY v NULLS LAST, event_id) / count(v) OVER (), 8) END AS r FROM (SELECT event_id, {_GAP} AS v FROM events)")
def w3(spark, d):
    gaps = table(spark, d, "events").select("event_id", F.when(F.col("value") > 10, F.col("value")).alias("v"))
    return windows.percentile_rank(gaps, "v", "event_id").select("event_id", F.round("percentile_rank", 8).alias("r"))


@query(
    "w3_percentile_rank_weighted",
    "SELECT o_orderkey, round(sum(w) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY o_orderstatus), 8) AS r FROM (SELECT *, (o_custkey % 7 + 1)::double AS w FROM orders)",
)
def w3w(spark, d):
    rows = table(spark, d, "orders").withColumn("w", F.col("o_custkey") % 7 + 1)
    return windows.percentile_rank(rows, "o_totalprice", "o_orderkey", "w", by=["o_orderstatus"]).select("o_orderkey", F.round("percentile_rank", 8).alias("r"))


def _rolling(size: int, offset: int, value: str = "value") -> str:
    return f"""WITH n AS (SELECT count(*) AS n FROM events), k AS (SELECT unnest(range(0, (n - {size}) // {offset} + 1)) AS w FROM n)
SELECT w AS window, count(*) AS n, round(avg({value}), 6) AS mean, max({value}) AS hi FROM k JOIN events ON event_id >= w * {offset} AND event_id < w * {offset} + {size} GROUP BY w"""


def _agg(x: str = "value"):
    return [F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.max(x).alias("hi")]


@query("w4_rolling_window", _rolling(7, 3))
def w4(spark, d):
    return windows.rolling_stats(table(spark, d, "events").select("event_id", "value"), "event_id", _agg(), size=7, offset=3)


@query("w6_rolling_stats", _rolling(50, 25))
def w6(spark, d):
    got = rolling.rolling_summary(table(spark, d, "events"), "event_id", "value", size=50, overlap=2, fit_edges=False, full=False)
    return got.select("window", F.col("size").alias("n"), F.round("mean", 6).alias("mean"), F.col("max").alias("hi"))


@query(
    "w7_nearest_stats",
    """WITH s AS (SELECT value AS x, user_id AS y, row_number() OVER (ORDER BY value, event_id) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT w AS window, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM (SELECT unnest(range(0, ((SELECT count(*) FROM events) - 100) // 50 + 1)) AS w) JOIN s ON r >= w * 50 AND r < w * 50 + 100 GROUP BY w""",
)
def w7(spark, d):
    ev = table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").alias("y"))
    x, y = rolling.nearest_summary(ev, "x", "y", "event_id", size=100, overlap=2, fit_edges=False, full=False)
    return x.select("window", F.round("mean", 6).alias("x")).join(y.select("window", F.round("mean", 6).alias("y")), "window")


@query(
    "w8_smoother_band",
    """WITH s AS (SELECT value AS x, user_id AS y, row_number() OVER (ORDER BY value, event_id) - 1 AS r FROM events), g AS (
SELECT w, avg(x) AS x, avg(y) AS y, stddev_pop(y) / sqrt(count(*)) AS e FROM (SELECT unnest(range(0, ((SELECT count(*) FROM events) - 200) // 100 + 1)) AS w) JOIN s ON r >= w * 100 AND r < w * 100 + 200 GROUP BY w)
SELECT round(x, 5) AS x, round(y, 5) AS y, round(y - 2 * e, 5) AS lo, round(y + 2 * e, 5) AS hi FROM g""",
)
def w8(spark, d):
    ev = table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").alias("y"))
    x, y = rolling.nearest_summary(ev, "x", "y", "event_id", size=200, overlap=2, fit_edges=False, full=False)
    got = x.select("window", F.col("mean").alias("x")).join(y.select("window", F.col("mean").alias("y"), F.col("std_err").alias("e")), "window")
    return got.select(F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round(F.col("y") - 2 * F.col("e"), 5).alias("lo"), F.round(F.col("y") + 2 * F.col("e"), 5).alias("hi"))


@query("w9_axis_band", "SELECT event_type, round(avg(value), 6) AS mean, round(avg(value) - stddev_pop(value) / sqrt(count(*)), 6) AS lo, round(avg(value) + stddev_pop(value) / sqrt(count(*)), 6) AS hi FROM events GROUP BY 1")
def w9(spark, d):
    e = F.stddev_pop("value") / F.sqrt(F.count("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg("value") - e, 6).alias("lo"), F.round(F.avg("value") + e, 6).alias("hi"))


@query(
    "w10_islands",
    "WITH o AS (SELECT event_id, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE event_type <> 'click') SELECT greatest(min(event_id) - 1, 0) AS start, max(event_id) AS stop FROM o GROUP BY g",
)
def w10(spark, d):
    return windows.islands(table(spark, d, "events"), "event_id", F.col("event_type") == "click")


@query(
    "w12_interp",
    "SELECT a.event_id AS k, round(a.value + (b.value - a.value) * 0.25, 6) AS value FROM events a JOIN events b ON b.event_id = a.event_id + 1",
)
def w12(spark, d):
    ev = table(spark, d, "events").select("event_id", "value")
    wanted = ev.select(F.col("event_id").alias("k"), (F.col("event_id") + 0.25).alias("at"))
    return windows.interpolate(ev, "event_id", "value", wanted, "at").select("k", F.round("value", 6).alias("value"))


@query(
    "w13_stretch",
    """WITH n AS (SELECT count(*) AS n FROM events), t AS (SELECT i, least(i * ((n - 1) / 499.0::double), n - 1) AS p FROM n, unnest(range(500)) AS u(i))
SELECT i AS place, round(a.value + (b.value - a.value) * (p - floor(p)), 5) AS value FROM t JOIN events a ON a.event_id = floor(p) JOIN events b ON b.event_id = ceil(p)""",
)
def w13(spark, d):
    return windows.stretch(table(spark, d, "events").select("event_id", "value"), "event_id", "value", 500).select("place", F.round("value", 5).alias("value"))


@query(
    "r12_autocorr",
    """WITH c AS (SELECT date_diff('day', DATE '2024-01-01', ts::date) AS p, count(*)::double AS n FROM events GROUP BY 1)
SELECT CAST(k AS INTEGER) AS lag, round(corr(a.n, b.n), 6) AS corr FROM c a JOIN c b ON b.p > a.p AND b.p <= a.p + (SELECT count(*) // 2 FROM c) CROSS JOIN LATERAL (SELECT b.p - a.p AS k) GROUP BY k""",
)
def r12(spark, d):
    days = table(spark, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return spectral.autocorrelation(days, "p", "n").select("lag", F.round("corr", 6).alias("corr"))


@query(
    "r12_autocorr_events",
    """WITH s AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events)
SELECT CAST(b.p - a.p AS INTEGER) AS lag, round(corr(a.value, b.value), 6) AS corr FROM s a JOIN s b ON b.p > a.p AND b.p <= a.p + (SELECT count(*) // 2 FROM s) GROUP BY 1""",
)
def r12_events(spark, d):
    ev = ordinal(table(spark, d, "events").select("ts", "event_id", "value"), [F.col("ts"), F.col("event_id")], "p")
    return spectral.autocorrelation(ev, "p", "value").select("lag", F.round("corr", 6).alias("corr"))
