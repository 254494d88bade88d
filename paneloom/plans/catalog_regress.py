"""Queries of cross moments and regression, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.operators import multivariate, regress

from .registry import query
from .tables import table

_GAPS = "SELECT l_returnflag AS g, l_quantity AS x0, nullif(l_discount, 0) AS x1, CASE WHEN l_tax > 0.01 THEN l_extendedprice / 1000 END AS x2, (l_linenumber % 4)::double AS w FROM lineitem"


def _gaps(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x0"), F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("x1"), F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice") / 1000).alias("x2"), (F.col("l_linenumber") % 4).cast("double").alias("w"))


def _pairs(stat: str, by: str = "") -> str:
    g = f"{by}," if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    m = ", ".join(f"sum(CASE WHEN x{i} IS NOT NULL THEN w * x{i} END) / sum(CASE WHEN x{i} IS NOT NULL THEN w END) AS m{i}" for i in range(3))
    v = ", ".join(f"sum(w * (x{i} - m{i}) * (x{i} - m{i})) / sum(CASE WHEN x{i} IS NOT NULL THEN w END) AS v{i}" for i in range(3))
    parts = []
    for i in range(3):
        for j in range(3):
            both = f"x{i} IS NOT NULL AND x{j} IS NOT NULL"
            mean = f"sum(CASE WHEN {both} THEN w * x{i} * x{j} END) / sum(CASE WHEN {both} THEN w END)"
            cov = f"({mean} - any_value(m{i}) * any_value(m{j}))"
            parts.append(f"SELECT {g} 'x{i}' AS i, 'x{j}' AS j, {stat.format(both=both, mean=mean, cov=cov, vi=f'any_value(v{i})', vj=f'any_value(v{j})', jj=f'(sum(w * x{j} * x{j}) / sum(CASE WHEN x{j} IS NOT NULL THEN w END))')} FROM b JOIN m {on} JOIN v {on} {group}")
    return f"WITH b AS (SELECT * FROM ({_GAPS}) WHERE w > 0), m AS (SELECT {g} {m} FROM b {group}), v AS (SELECT {g} {v} FROM b JOIN m {on} {group}) " + " UNION ALL ".join(parts)


@query("g3_moment_matrix", _pairs("count(CASE WHEN {both} THEN 1 END) AS count, round({mean}, 6) AS mean, round({cov}, 6) AS variance"))
def g3(spark, d):
    got = multivariate.multivariate(_gaps(spark, d), ["x0", "x1", "x2"], "w", shifts=[25.0, 0.05, 30.0])
    return got.select("i", "j", "count", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("g6_correlation_missing", _pairs("round({cov} / sqrt({vi} * {vj}), 6) AS correlation", "g"))
def g6(spark, d):
    got = multivariate.multivariate(_gaps(spark, d), ["x0", "x1", "x2"], "w", ["g"], shifts=[25.0, 0.05, 30.0])
    return got.select("g", "i", "j", F.round("correlation", 6).alias("correlation"))


@query("g7_multiple", _pairs("round({mean} / {jj}, 6) AS multiple"))
def g7(spark, d):
    return multivariate.multivariate(_gaps(spark, d), ["x0", "x1", "x2"], "w").select("i", "j", F.round("multiple", 6).alias("multiple"))


@query("k10_matrix_table", "SELECT 'l_quantity' AS factor, 1.0::double AS l_quantity, round(corr(l_quantity, l_extendedprice), 6) AS l_extendedprice FROM lineitem UNION ALL SELECT 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6), 1.0 FROM lineitem")
def k10(spark, d):
    names = ["l_quantity", "l_extendedprice"]
    got = multivariate.as_matrix(multivariate.multivariate(table(spark, d, "lineitem"), names, shifts=[25.0, 30000.0]), "correlation", names)
    return got.select("factor", *[F.round(n, 6).alias(n) for n in names])


def _ols(x: str, y: str, w: str, src: str, by: str = "") -> str:
    """SQL of a weighted fit with one predictor: closed form, then residuals."""
    g = f"{by}," if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""WITH b AS (SELECT {g} {x} AS x, {y} AS y, {w} AS w FROM {src}), m AS (SELECT {g} sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM b {group}),
c AS (SELECT {g} any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS beta, sum(w * (x - mx) * (x - mx)) / sum(w) AS vx, sum(w * (y - my) * (y - my)) / sum(w) AS vy, sum(w) * sum(w) / sum(w * w) AS dc, count(*) AS n FROM b JOIN m {on} {group}),
r AS (SELECT {g} sum(w * (y - my - beta * (x - mx)) * (y - my - beta * (x - mx))) / sum(w) AS rs FROM b JOIN c {on} {group})
SELECT {g} n AS count, round(beta, 4) AS x, round(my - beta * mx, 3) AS constant, round(1 - rs / vy, 6) AS "R2", round(beta / sqrt(rs / vx / dc), 3) AS "xT" FROM c JOIN r {on}"""


def _fit_columns(got, by=()):
    return got.select(*by, "count", F.round("x", 4).alias("x"), F.round("constant", 3).alias("constant"), F.round("R2", 6).alias("R2"), F.round("xT", 3).alias("xT"))


@query("r2_ols_k1", _ols("l_quantity", "l_extendedprice", "1.0::double", "lineitem"))
def r2(spark, d):
    return _fit_columns(regress.regress(table(spark, d, "lineitem").withColumn("x", F.col("l_quantity")), "l_extendedprice", ["x"]))


@query("r2_ols_k1_grouped", _ols("l_quantity", "l_extendedprice", "1.0::double", "lineitem", "l_returnflag"))
def r2g(spark, d):
    return _fit_columns(regress.regress(table(spark, d, "lineitem").withColumn("x", F.col("l_quantity")), "l_extendedprice", ["x"], by=["l_returnflag"]), ["l_returnflag"])


@query("r2_ols_weighted", _ols("l_quantity", "l_extendedprice", "l_linenumber::double", "lineitem"))
def r2w(spark, d):
    return _fit_columns(regress.regress(table(spark, d, "lineitem").withColumn("x", F.col("l_quantity")), "l_extendedprice", ["x"], "l_linenumber"))


@query(
    "r2_ols_k2",
    """WITH m AS (SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_tax, l_tax) AS s22, covar_pop(l_quantity, l_tax) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_tax, l_extendedprice) AS s2y, avg(l_quantity) AS a, avg(l_tax) AS b, avg(l_extendedprice) AS y FROM lineitem),
c AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2, a, b, y FROM m)
SELECT round(b1, 4) AS l_quantity, round(b2, 3) AS l_tax, round(y - b1 * a - b2 * b, 3) AS constant FROM c""",
)
def r22(spark, d):
    got = regress.regress(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"])
    return got.select(F.round("l_quantity", 4).alias("l_quantity"), F.round("l_tax", 3).alias("l_tax"), F.round("constant", 3).alias("constant"))


@query(
    "r2_ols_no_constant",
    """WITH c AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS b, avg(l_extendedprice * l_extendedprice) AS s FROM lineitem)
SELECT round(any_value(b), 4) AS x, round(1 - avg((l_extendedprice - b * l_quantity) * (l_extendedprice - b * l_quantity)) / any_value(s), 6) AS "R2" FROM lineitem, c""",
)
def r2n(spark, d):
    got = regress.regress(table(spark, d, "lineitem").withColumn("x", F.col("l_quantity")), "l_extendedprice", ["x"], constant=False)
    return got.select(F.round("x", 4).alias("x"), F.round("R2", 6).alias("R2"))


@query("r3_forecast", "SELECT l_returnflag, round(sum(regr), 0) AS total FROM (SELECT l_returnflag, (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity + (SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) AS regr FROM lineitem) GROUP BY 1")
def r3(spark, d):
    li = table(spark, d, "lineitem")
    fits = regress.fit(li, "l_extendedprice", ["l_quantity"])
    return regress.forecast(li, fits, ["l_quantity"]).groupBy("l_returnflag").agg(F.round(F.sum("predicted"), 0).alias("total"))


@query(
    "r9_buckets_with_all",
    """SELECT label, round(regr_slope(l_extendedprice, l_quantity), 4) AS x, count(*) AS count FROM (SELECT 'All' AS label, * FROM lineitem UNION ALL SELECT 'cheap', * FROM lineitem WHERE l_discount < 0.03 UNION ALL SELECT 'Other', * FROM lineitem WHERE l_discount >= 0.03) GROUP BY label""",
)
def r9(spark, d):
    li = table(spark, d, "lineitem").withColumn("x", F.col("l_quantity"))
    labels = F.array(F.lit("All"), F.when(F.col("l_discount") < 0.03, F.lit("cheap")).otherwise(F.lit("Other")))
    got = regress.regress(li.withColumn("label", F.explode(labels)), "l_extendedprice", ["x"], by=["label"])
    return got.select("label", F.round("x", 4).alias("x"), "count")


@query("r10_loop", 'SELECT \'l_extendedprice\' AS response, round(regr_slope(l_extendedprice, l_quantity), 4) AS l_quantity, round(regr_r2(l_extendedprice, l_quantity), 6) AS "R2" FROM lineitem UNION ALL SELECT \'l_tax\', round(regr_slope(l_tax, l_quantity), 4), round(regr_r2(l_tax, l_quantity), 6) FROM lineitem')
def r10(spark, d):
    got = regress.loop(table(spark, d, "lineitem"), ["l_extendedprice", "l_tax"], ["l_quantity"])
    return got.select("response", F.round("l_quantity", 4).alias("l_quantity"), F.round("R2", 6).alias("R2"))


@query("r10_panel", "SELECT CAST(1 AS INTEGER) AS n_predictors, round(regr_slope(l_extendedprice, l_quantity), 4) AS l_quantity, CAST(NULL AS DOUBLE) AS l_tax FROM lineitem UNION ALL SELECT 2, l_quantity, l_tax FROM (WITH m AS (SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_tax, l_tax) AS s22, covar_pop(l_quantity, l_tax) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_tax, l_extendedprice) AS s2y FROM lineitem) SELECT round((s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12), 4) AS l_quantity, round((s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12), 3) AS l_tax FROM m)")
def r10p(spark, d):
    got = regress.panel(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"])
    return got.select("n_predictors", F.round("l_quantity", 4).alias("l_quantity"), F.round("l_tax", 3).alias("l_tax"))


@query("g8_pair_sums", _pairs("round({mean} * count(CASE WHEN {both} THEN 1 END), 3) AS sum, round(sum(CASE WHEN {both} THEN w END) / count(CASE WHEN {both} THEN 1 END), 9) AS mean_wt, round(pow(sum(CASE WHEN {both} THEN w END), 2) / sum(CASE WHEN {both} THEN w * w END), 5) AS d_count, count(CASE WHEN {both} THEN 1 END) AS count", "g"))
def g8(spark, d):
    got = multivariate.multivariate(_gaps(spark, d), ["x0", "x1", "x2"], "w", ["g"])
    return got.select("g", "i", "j", F.round("sum", 3).alias("sum"), F.round("mean_wt", 9).alias("mean_wt"), F.round("d_count", 5).alias("d_count"), "count")


@query("g10_moments_by_step", "SELECT event_id // 300 AS clump, count(*) AS count, round(covar_pop(value, user_id), 5) AS variance, round(corr(value, user_id), 8) AS correlation FROM events GROUP BY 1")
def g10(spark, d):
    got = multivariate.multivariate_steps(table(spark, d, "events"), ["value", "user_id"], "event_id", 300, shifts=[50.0, 500.0])
    return got.where("i = 'value' AND j = 'user_id'").select("clump", "count", F.round("variance", 5).alias("variance"), F.round("correlation", 8).alias("correlation"))


@query(
    "r6_errors",
    """WITH b AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT g, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS beta, var_pop(x) AS vx FROM b GROUP BY g),
r AS (SELECT g, avg((y - my - beta * (x - mx)) * (y - my - beta * (x - mx))) AS rs FROM b JOIN m USING (g) GROUP BY g)
SELECT g, count(*) AS n, round(avg(sqrt(rs * (1 + (x - mx) * (x - mx) / vx))), 3) AS mean_error, round(max(sqrt(rs * (1 + (x - mx) * (x - mx) / vx))), 3) AS largest FROM b JOIN m USING (g) JOIN r USING (g) GROUP BY g""",
)
def r6(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    got = regress.errors(rows, "y", ["x"], by=["g"])
    return got.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("error"), 3).alias("mean_error"), F.round(F.max("error"), 3).alias("largest"))
