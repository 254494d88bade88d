"""Queries of rolling full and multivariate statistics, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.operators import rolling

from .catalog_stats import NINE, sql_quantiles
from .registry import query
from .tables import table


def _windows(src: str, size: int, offset: int, pos: str = "event_id") -> str:
    """SQL of the rows of `src` in every full window, with its number as `win`."""
    return f"SELECT k.win, s.* FROM (SELECT unnest(range(0, ((SELECT count(*) FROM {src}) - {size}) // {offset} + 1)) AS win) k JOIN {src} s ON s.{pos} >= k.win * {offset} AND s.{pos} < k.win * {offset} + {size}"


_ROWS = "SELECT event_id, CASE WHEN value > 10 THEN value END AS x, user_id::double AS y, CASE WHEN user_id % 4 > 0 THEN user_id % 4 + (event_id % 7) / 9.7::double ELSE 0.0::double END AS w FROM events"
#: Some quantiles end in exactly half of the last digit that is shown; a little more decides for both engines.
_NINE_ROUND = ", ".join(f"round({n} + 1e-9::double, 6) AS {n}" for n in NINE)


def _rows(spark, d):
    ev = table(spark, d, "events")
    w = F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 4 + F.col("event_id") % 7 / F.lit(9.7)).otherwise(F.lit(0.0))
    return ev.select("event_id", F.when(F.col("value") > 10, F.col("value")).alias("x"), F.col("user_id").cast("double").alias("y"), w.alias("w"))


def _full(size: int, offset: int) -> str:
    return f"""
WITH r AS ({_ROWS}), v AS ({_windows("r", size, offset)}),
q AS ({sql_quantiles("x", "w", "v", "win", NINE)}),
away AS (SELECT win, abs(x - median) AS x, w FROM v JOIN q USING (win) WHERE x IS NOT NULL AND w > 0),
m AS ({sql_quantiles("x", "w", "away", "win", {"mad": 0.5})}),
s AS (SELECT win, count(*) AS size, count(CASE WHEN w > 0 THEN x END) AS count, sum(CASE WHEN w > 0 THEN x * w END) / sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w END) AS mean FROM v GROUP BY win),
d AS (SELECT win, sqrt(sum(w * (x - mean) * (x - mean)) / sum(w)) AS std_dev, min(x) AS min, max(x) AS max, arg_min(event_id, (x, event_id)) AS min_id, arg_min(event_id, (-x, event_id)) AS max_id FROM v JOIN s USING (win) WHERE x IS NOT NULL AND w > 0 GROUP BY win)
SELECT win AS window, size, count, round(mean + 1e-9::double, 6) AS mean, round(std_dev + 1e-9::double, 6) AS std_dev, min, min_id, max, max_id, {_NINE_ROUND}, round(mad + 1e-9::double, 6) AS mad FROM s JOIN d USING (win) JOIN q USING (win) JOIN m USING (win)"""


@query("w6_rolling_full", _full(60, 20))
def w6_full(spark, d):
    got = rolling.rolling_summary(_rows(spark, d), "event_id", "x", "w", size=60, offset=20)
    shown = [F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "std_dev", *NINE, "mad")]
    return got.select("window", "size", "count", "min", "min_id", "max", "max_id", *shown)


def _cross(size: int, offset: int) -> str:
    cells = []
    for i in "xy":
        for j in "xy":
            both = f"{i} IS NOT NULL AND {j} IS NOT NULL"
            mean = f"sum(CASE WHEN {both} THEN w * {i} * {j} END) / sum(CASE WHEN {both} THEN w END)"
            cov = f"({mean} - any_value(m{i}) * any_value(m{j}))"
            cells.append(f"SELECT win AS window, '{i}' AS i, '{j}' AS j, count(CASE WHEN {both} THEN 1 END) AS count, round({mean} + 1e-7::double, 4) AS mean, round({cov} + 1e-7::double, 4) AS variance, round({cov} / sqrt(any_value(v{i}) * any_value(v{j})), 6) AS correlation FROM b GROUP BY win")
    middle = ", ".join(f"sum(w * {i}) OVER win_ / sum(CASE WHEN {i} IS NOT NULL THEN w END) OVER win_ AS m{i}, sum(w * {i} * {i}) OVER win_ / sum(CASE WHEN {i} IS NOT NULL THEN w END) OVER win_ AS s{i}" for i in "xy")
    return f"WITH r AS ({_ROWS}), a AS ({_windows('r', size, offset)}), p AS (SELECT *, {middle} FROM a WHERE w > 0 WINDOW win_ AS (PARTITION BY win)), b AS (SELECT *, sx - mx * mx AS vx, sy - my * my AS vy FROM p) " + " UNION ALL ".join(cells)


@query("w6_rolling_multivariate", _cross(100, 25))
def w6_multivariate(spark, d):
    got = rolling.rolling_multivariate(_rows(spark, d), "event_id", ["x", "y"], "w", size=100, offset=25)
    return got.select("window", "i", "j", "count", F.round(F.col("mean") + 1e-7, 4).alias("mean"), F.round(F.col("variance") + 1e-7, 4).alias("variance"), F.round("correlation", 6).alias("correlation"))


@query(
    "w7_nearest_full",
    f"""
WITH r AS (SELECT value AS x, user_id::double AS y, row_number() OVER (ORDER BY value, event_id) - 1 AS event_id FROM events), v AS ({_windows("r", 100, 20)}),
a AS ({sql_quantiles("x", "1.0::double", "v", "win", {"x_median": 0.5})}), b AS ({sql_quantiles("y", "1.0::double", "v", "win", {"y_p90": 0.9, "y_median": 0.5, "y_p10": 0.1})})
SELECT win AS window, round(x_median, 6) AS x_median, round(y_p90, 6) AS y_p90, round(y_median, 6) AS y_median, round(y_p10, 6) AS y_p10 FROM a JOIN b USING (win)""",
)
def w7_full(spark, d):
    ev = table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    x, y = rolling.nearest_summary(ev, "x", "y", "event_id", size=100, overlap=5, fit_edges=False)
    x = x.select("window", F.round("median", 6).alias("x_median"))
    return x.join(y.select("window", *[F.round(c, 6).alias(f"y_{c}") for c in ("p90", "median", "p10")]), "window")
