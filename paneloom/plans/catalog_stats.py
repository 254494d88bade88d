"""Queries of the statistics operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.operators import quantiles, stats, userdefined

from .registry import query
from .tables import table

LINE_W = "l_quantity"


def sql_moments(x: str, w: str | None, src: str, by: str = "", having: str = "") -> str:
    """SQL of the moments of x (NULL: missing) by group: two passes for the variance."""
    g = f"{by}," if by else ""
    on = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    w = w or "1.0::double"
    return f"""
WITH b AS (SELECT {g} {x} AS x0, {w} AS w0 FROM {src}),
v AS (SELECT *, CASE WHEN x0 IS NOT NULL AND w0 > 0 THEN x0 END AS x, CASE WHEN x0 IS NOT NULL AND w0 > 0 THEN w0 END AS w FROM b),
m AS (SELECT {g} sum(w * x) / sum(w) AS mu FROM v {group}),
s AS (SELECT {g} count(*) AS size, count(x) AS count, sum(w) * sum(w) / sum(w * w) AS d_count, avg(w) AS mean_wt, any_value(mu) AS mean,
 sum(w * x * x) / sum(w) AS mean_square, CASE WHEN count(x) > 1 THEN sum(w * (x - mu) * (x - mu)) / sum(w) END AS variance, min(x) + 0.0::double AS min, max(x) AS max
 FROM v JOIN m {on} {group})
SELECT {g} size, count, round(d_count, 6) AS d_count, round(mean_wt, 6) AS mean_wt, round(mean * count, 4) AS sum, round(mean, 6) AS mean,
 round(mean_square * count / 1e8::double, 5) AS sum_square, round(mean_square, 2) AS mean_square, round(variance, 2) AS variance, round(sqrt(variance), 6) AS std_dev,
 round(sqrt(variance) / sqrt(d_count), 6) AS std_err, CASE WHEN variance > 0 THEN round(mean / (sqrt(variance) / sqrt(d_count)), 4) END AS t_stat, min, max FROM s {having}"""


DIGITS = {"d_count": 6, "mean_wt": 6, "sum": 4, "mean": 6, "mean_square": 2, "variance": 2, "std_dev": 6, "std_err": 6, "t_stat": 4}


def rounded(df):
    """Doubles as both engines sum them; sum_square in units of 1e8."""
    return df.withColumn("sum_square", F.round(F.col("sum_square") / 1e8, 5)).withColumns({c: F.round(c, n) for c, n in DIGITS.items() if c in df.columns})


def sql_quantiles(x: str, w: str, src: str, by: str, qs: dict[str, float]) -> str:
    """SQL of interpolated weighted quantiles by a running sum over rows ordered by value and weight."""
    cols = ", ".join(f"coalesce(max(CASE WHEN c >= {q} * tw + tw / n / 2 AND (pc IS NULL OR pc < {q} * tw + tw / n / 2) THEN CASE WHEN px IS NULL THEN x ELSE ((c - ({q} * tw + tw / n / 2)) * px + (({q} * tw + tw / n / 2) - pc) * x) / (c - pc) END END), max(x)) AS {name}" for name, q in qs.items())
    return f"""
WITH v AS (SELECT {by}, {x} AS x, {w} AS w FROM {src} WHERE {x} IS NOT NULL AND {w} > 0),
c AS (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY x, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY {by}) AS tw, count(*) OVER (PARTITION BY {by}) AS n FROM v),
p AS (SELECT *, lag(x) OVER (PARTITION BY {by} ORDER BY x, w, c) AS px, lag(c) OVER (PARTITION BY {by} ORDER BY x, w, c) AS pc FROM c)
SELECT {by}, {cols} FROM p GROUP BY {by}"""


NINE = {quantiles.percentile_name(q): q for q in quantiles.PERCENTILES}


@query(
    "a22_weighted_summary_by_flag",
    f"""
WITH q AS ({sql_quantiles("l_extendedprice", LINE_W, "lineitem", "l_returnflag", {"median": 0.5})}),
d AS (SELECT l_returnflag, abs(l_extendedprice - median) AS x, l_quantity AS w FROM lineitem JOIN q USING (l_returnflag)),
a AS ({sql_quantiles("x", "w", "d", "l_returnflag", {"mad": 0.5})}),
m AS ({sql_moments("l_extendedprice", LINE_W, "lineitem", "l_returnflag")})
SELECT m.*, round(median, 4) AS median, round(mad, 4) AS mad FROM m JOIN q USING (l_returnflag) JOIN a USING (l_returnflag)""",
)
def a22(spark, d):
    got = stats.summary(table(spark, d, "lineitem"), "l_extendedprice", LINE_W, by=["l_returnflag"], quantiles=[0.5], mad=True)
    return rounded(got).withColumns({"median": F.round("median", 4), "mad": F.round("mad", 4)})


@query("a23_group_stats", sql_moments("o_totalprice", None, "orders", "o_orderpriority"))
def a23(spark, d):
    return rounded(stats.summary(table(spark, d, "orders"), "o_totalprice", by=["o_orderpriority"]))


@query("a20_moments_with_missing", sql_moments("nullif(l_discount, 0)", "CASE WHEN l_tax > 0.02 THEN l_quantity ELSE -1 END", "lineitem", "l_linestatus"))
def a20(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("x"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).otherwise(F.lit(-1.0)).alias("w"))
    return rounded(stats.summary(li, "x", "w", by=["l_linestatus"]))


_NINE_ROUND = ", ".join(f"round({n}, 4) AS {n}" for n in NINE)


@query("a13_nine_quantiles", f"SELECT l_returnflag, {_NINE_ROUND} FROM ({sql_quantiles('l_extendedprice', LINE_W, 'lineitem', 'l_returnflag', NINE)})")
def a13(spark, d):
    got = quantiles.weighted_quantiles(table(spark, d, "lineitem"), "l_extendedprice", LINE_W, by=["l_returnflag"])
    return got.select("l_returnflag", *[F.round(n, 4).alias(n) for n in NINE])


@query("a13_quantiles_unweighted", f"SELECT l_linestatus, {_NINE_ROUND} FROM ({sql_quantiles('l_extendedprice', '1.0::double', 'lineitem', 'l_linestatus', NINE)})")
def a13u(spark, d):
    got = quantiles.weighted_quantiles(table(spark, d, "lineitem"), "l_extendedprice", by=["l_linestatus"])
    return got.select("l_linestatus", *[F.round(n, 4).alias(n) for n in NINE])


@query(
    "a14_mad",
    f"""
WITH q AS ({sql_quantiles("o_totalprice", "1.0::double", "orders", "o_orderstatus", {"median": 0.5})}),
x AS (SELECT o_orderstatus, abs(o_totalprice - median) AS x, 1.0::double AS w FROM orders JOIN q USING (o_orderstatus))
SELECT o_orderstatus, round(mad, 4) AS mad FROM ({sql_quantiles("x", "w", "x", "o_orderstatus", {"mad": 0.5})})""",
)
def a14(spark, d):
    got = quantiles.weighted_quantiles(table(spark, d, "orders"), "o_totalprice", by=["o_orderstatus"], quantiles=[], mad=True)
    return got.select("o_orderstatus", F.round("mad", 4).alias("mad"))


def _short(x, w=None):
    m = stats.moments(x, w)
    return [m["size"].alias("size"), m["count"].alias("count"), F.round(m["mean"], 6).alias("mean"), F.round(m["std_dev"], 6).alias("std_dev")]


_SHORT = "count(*) AS size, count({x}) AS count, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std_dev"


@query("a24_split", f"SELECT CASE WHEN l_discount > 0.05 THEN 'True' ELSE 'Other' END AS label, {_SHORT.format(x='l_extendedprice')} FROM lineitem GROUP BY 1")
def a24(spark, d):
    return stats.bucketed(table(spark, d, "lineitem"), {"True": F.col("l_discount") > 0.05}, _short("l_extendedprice"))


@query(
    "a25_overlapping_buckets",
    f"""SELECT label, {_SHORT.format(x='o_totalprice')} FROM (
SELECT 'high' AS label, o_totalprice FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 'urgent', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'Other', o_totalprice FROM orders WHERE NOT (o_totalprice > 100000 OR o_orderpriority = '1-URGENT')) GROUP BY label""",
)
def a25(spark, d):
    buckets = {"high": F.col("o_totalprice") > 100000, "urgent": F.col("o_orderpriority") == "1-URGENT"}
    return stats.bucketed(table(spark, d, "orders"), buckets, _short("o_totalprice"))


@query("a26_label_all", f"SELECT coalesce(o_orderstatus, 'All') AS label, {_SHORT.format(x='o_totalprice')} FROM orders GROUP BY ROLLUP (o_orderstatus)")
def a26(spark, d):
    return stats.with_total(table(spark, d, "orders"), "o_orderstatus", _short("o_totalprice"))


@query("a27_step_clumps", f"SELECT (event_id // 100) * 100 AS start, {_SHORT.format(x='value')} FROM events GROUP BY 1")
def a27(spark, d):
    return table(spark, d, "events").groupBy(stats.clump_start("event_id", 100).alias("start")).agg(*_short("value"))


@query(
    "a27_step_list",
    f"SELECT CASE WHEN event_id < 10 THEN 0 WHEN event_id < 40 THEN 10 ELSE 40 + ((event_id - 40) // 30) * 30 END AS start, {_SHORT.format(x='value')} FROM events GROUP BY 1",
)
def a27l(spark, d):
    return table(spark, d, "events").groupBy(stats.clump_start("event_id", [10, 30]).alias("start")).agg(*_short("value"))


_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("a27_axis", " UNION ALL ".join(f"SELECT '{c}' AS variable, {_SHORT.format(x=c)} FROM lineitem" for c in _FOUR))
def a27a(spark, d):
    return stats.unpivoted(table(spark, d, "lineitem"), _FOUR).groupBy("variable").agg(*_short("value"))


@query(
    "a28_loop_summary",
    " UNION ALL ".join(f"SELECT '{c}' AS variable, l_returnflag, round(sum(l_quantity * {c}) / sum(l_quantity), 6) AS mean FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag" for c in ("l_discount", "l_tax")),
)
def a28(spark, d):
    rows = stats.unpivoted(table(spark, d, "lineitem"), ("l_discount", "l_tax"), ("l_returnflag", "l_quantity"))
    return rows.groupBy("variable", "l_returnflag").agg(F.round(stats.moments("value", "l_quantity")["mean"], 6).alias("mean"))


@query(
    "a29_col_summary",
    "SELECT l_linestatus, count(*) AS count, round(sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity), 4) AS d_count, round(avg(l_quantity), 6) AS mean_weight, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS price, round(sum(l_quantity * l_tax) / sum(l_quantity), 6) AS l_tax FROM lineitem GROUP BY l_linestatus",
)
def a29(spark, d):
    got = stats.column_summary(table(spark, d, "lineitem"), ["l_extendedprice/price%9.2f", "l_tax"], "l_quantity", by=["l_linestatus"])
    return got.withColumns({"d_count": F.round("d_count", 4), "mean_weight": F.round("mean_weight", 6), "price": F.round("price", 4), "l_tax": F.round("l_tax", 6)})


_BIN = "CASE WHEN x IS NULL THEN 'Other' WHEN x < 0.03 THEN '_0.03' WHEN x < 0.07 THEN '0.03_0.07' ELSE '0.07_' END"


@query("a31_bucketer_1d", f"SELECT coalesce(b, 'All') AS label, {_SHORT.format(x='y')} FROM (SELECT {_BIN} AS b, y FROM (SELECT nullif(l_discount, 0) AS x, l_extendedprice AS y FROM lineitem)) GROUP BY ROLLUP (b)")
def a31(spark, d):
    li = table(spark, d, "lineitem")
    return stats.bucket_cube(li, {"d": stats.bin_label(F.nullif("l_discount", F.lit(0.0)), [0.03, 0.07])}, _short("l_extendedprice"))


@query(
    "a31_bucketer_2d_cube",
    f"""SELECT CASE WHEN grouping(b) = 1 THEN 'All' ELSE b END || '|' || CASE WHEN grouping(q) = 1 THEN 'All' ELSE q END AS label, {_SHORT.format(x='y')} FROM (
SELECT {_BIN} AS b, CASE WHEN l_quantity < 10 THEN '_10' WHEN l_quantity < 30 THEN '10_30' ELSE '30_' END AS q, y FROM (SELECT nullif(l_discount, 0) AS x, l_quantity, l_extendedprice AS y FROM lineitem)) GROUP BY CUBE (b, q)""",
)
def a31c(spark, d):
    bins = {"d": stats.bin_label(F.nullif("l_discount", F.lit(0.0)), [0.03, 0.07]), "q": stats.bin_label("l_quantity", [10, 30])}
    return stats.bucket_cube(table(spark, d, "lineitem"), bins, _short("l_extendedprice"))


@query("a16_negative_weights", sql_moments("c_nationkey * sign(c_acctbal)", "abs(c_acctbal)", "customer", "c_mktsegment"))
def a16(spark, d):
    return rounded(stats.summary(table(spark, d, "customer"), "c_nationkey", "c_acctbal", by=["c_mktsegment"], negative_weights=True))


@query(
    "a12_min_max_id",
    """WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)
SELECT e.event_type, any_value(lo) AS min, min(CASE WHEN value = lo THEN event_id END) AS min_id, any_value(hi) AS max, min(CASE WHEN value = hi THEN event_id END) AS max_id FROM events e JOIN m USING (event_type) GROUP BY e.event_type""",
)
def a12(spark, d):
    got = stats.extremes("value", "event_id")
    return table(spark, d, "events").groupBy("event_type").agg(*[c.alias(n) for n, c in got.items()])


@query(
    "a32_percentile_nointerp",
    """WITH c AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS c, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem)
SELECT l_returnflag, min(CASE WHEN c / t >= 0.25 - 1e-12 THEN x END) AS p25, min(CASE WHEN c / t >= 0.9 - 1e-12 THEN x END) AS p90 FROM c GROUP BY l_returnflag""",
)
def a32(spark, d):
    return quantiles.step_percentile(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", [0.25, 0.9], ["l_returnflag"])


@query("a33_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def a33(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    "a35_gini",
    """WITH b AS (SELECT c_mktsegment AS s, c_acctbal AS m, 1.0::double AS n FROM customer WHERE c_acctbal > 0),
r AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY m) AS u, sum(n) OVER (PARTITION BY s) AS p, sum(n * m) OVER (PARTITION BY s) AS t, count(*) OVER (PARTITION BY s, m) AS k FROM b)
SELECT s AS c_mktsegment, round(1 - 2 * sum(n * m / t * (p - u + k / 2.0) / p), 6) AS gini FROM r GROUP BY s""",
)
def a35(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_mktsegment", "c_acctbal").agg(F.count(F.lit(1)).alias("n"))
    return stats.gini(rich, "n", "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", F.round("gini", 6).alias("gini"))


@query(
    "a36_theil",
    "WITH b AS (SELECT c_mktsegment, c_acctbal AS m, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS mu FROM customer WHERE c_acctbal > 0) SELECT c_mktsegment, round(sum(m * ln(m / mu)) / sum(m), 6) AS theil FROM b GROUP BY c_mktsegment",
)
def a36(spark, d):
    got = stats.theil(table(spark, d, "customer").where("c_acctbal > 0").withColumn("one", F.lit(1)), "one", "c_acctbal", ["c_mktsegment"])
    return got.select("c_mktsegment", F.round("theil", 6).alias("theil"))


@query("z5_aggregate_registry", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std_dev FROM orders GROUP BY o_orderstatus")
def z5(spark, d):
    orders = table(spark, d, "orders")
    return orders.groupBy("o_orderstatus").agg(*[F.round(stats.AGGREGATES[s]("o_totalprice", None), 4).alias(s) for s in ("mean", "std_dev")])


@query(
    "z5_aggregate_of_own_state",
    """WITH m AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, round(sum(power(value - mu, 3)) / count(*) / power(any_value(s), 3), 6) AS skewness FROM events JOIN m USING (event_type) GROUP BY 1""",
)
def z5_own(spark, d):
    """Skewness, by states of count, mean and sums of second and third powers that are merged."""

    def merge(a, b):
        n = a[0] + b[0]
        if not a[0] or not b[0]:
            return a if a[0] else b
        d, m2, m3 = b[1] - a[1], a[2] + b[2], a[3] + b[3]
        m3 += d**3 * a[0] * b[0] * (a[0] - b[0]) / n**2 + 3 * d * (a[0] * b[2] - b[0] * a[2]) / n
        return n, a[1] + d * b[0] / n, m2 + d * d * a[0] * b[0] / n, m3

    def step(state, row):
        return state if row["value"] is None else merge(state, (1, row["value"], 0.0, 0.0))

    def end(state):
        n, _, m2, m3 = state
        return {"n": n, "skewness": round(m3 / n / (m2 / n) ** 1.5, 6) if n and m2 else None}

    skewness = userdefined.Aggregate(lambda: (0, 0.0, 0.0, 0.0), step, merge, end)
    return userdefined.aggregate(table(spark, d, "events"), ["event_type"], ["value"], skewness, "n long, skewness double")
