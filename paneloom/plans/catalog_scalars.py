"""Queries of mathematical and string functions, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions import scalars, strings

from .registry import query
from .tables import table


def _acct(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"))


def _scalar(name: str, sql: str, build, digits: int = 8):
    """A query of one function of x = c_acctbal / 1000."""

    @query(name, f"SELECT c_custkey, round({sql}, {digits}) AS y FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")
    def run(spark, d):
        return _acct(spark, d).select("c_custkey", F.round(build(F.col("x")), digits).alias("y"))


_scalar("f1_dir_clip", "CASE WHEN x * 2.5 < 0 THEN 0 ELSE sign(x) * least(abs(x), 2.5) END", lambda x: scalars.dir_clip(x, 2.5))
_scalar("f2_toward_zero", "sign(x) * greatest(abs(x) - 1.5, 0)", lambda x: scalars.toward_zero(x, 1.5))
_scalar("f6_sigmoid", "1 / (1 + exp(-x))", scalars.sigmoid)
_scalar("f7_logit", "-ln(1 / (1 / (1 + exp(-x)) + 1e-8) - 1 + 1e-8)", lambda x: scalars.logit(scalars.sigmoid(x)), 5)
_scalar("f8_elu", "CASE WHEN x < 0 THEN 1.5 * (exp(x) - 1) ELSE x END", lambda x: scalars.elu(x, 1.5))
_scalar("f8_celu", "CASE WHEN x < 0 THEN 1.5 * (exp(x / 1.5) - 1) ELSE x END", lambda x: scalars.celu(x, 1.5))
_scalar("f9_ielu", "CASE WHEN x / 10 < 0 THEN ln(x / 10 + 1 + 1e-20) ELSE x / 10 END", lambda x: scalars.ielu(x / 10))
_scalar("f10_llu", "CASE WHEN abs(x) <= 1 THEN x ELSE sign(x) * (1 + ln(abs(x))) END", scalars.llu)
_scalar("f10_illu", "CASE WHEN abs(x) <= 1 THEN x ELSE sign(x) * exp(abs(x) - 1) END", scalars.illu, 4)
_scalar("f11_sroot", "sign(x) * pow(abs(x), 0.5)", scalars.sroot)
_scalar("f14_reciprocal_weights", "pow(1 / (1 + abs(x) * 2), 1.5)", lambda x: scalars.reciprocal_weights(F.abs(x), 2.0, 1.5))


@query("f3_per_clip", "SELECT c_custkey, round(greatest(least(c_acctbal, hi), lo), 6) AS y FROM customer, (SELECT quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.9) AS hi FROM customer)")
def f3(spark, d):
    return scalars.per_clip(table(spark, d, "customer"), "c_acctbal", (5, 90)).select("c_custkey", F.round("c_acctbal", 6).alias("y"))


@query("f4_scale2unit", "SELECT c_custkey, round(greatest(least(c_acctbal / t * 0.9, 1), -1), 8) AS y FROM customer, (SELECT quantile_cont(abs(c_acctbal), 0.99) AS t FROM customer)")
def f4(spark, d):
    return scalars.scale2unit(table(spark, d, "customer"), "c_acctbal", soft_clip=99.0).select("c_custkey", F.round("c_acctbal", 8).alias("y"))


@query("f5_softmax", "SELECT c_custkey, round(exp(x) / sum(exp(x)) OVER (PARTITION BY c_mktsegment), 10) AS y FROM (SELECT c_custkey, c_mktsegment, c_acctbal / 1000 AS x FROM customer)")
def f5(spark, d):
    rows = table(spark, d, "customer").withColumn("x", F.col("c_acctbal") / 1000)
    return scalars.softmax(rows, "x", ["c_mktsegment"]).select("c_custkey", F.round("softmax", 10).alias("y"))


@query("f12_zip_func", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(l_quantity, 30.0, nullif(l_discount, 0) * 400) * (CASE WHEN l_discount <> 0 THEN 1 END) AS lo, round((l_quantity + nullif(l_discount, 0)) / 2, 6) AS mean FROM lineitem")
def f12(spark, d):
    gap = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.zip_reduce("min", "l_quantity", 30, gap * 400).alias("lo"), F.round(scalars.zip_reduce("mean", "l_quantity", gap), 6).alias("mean"))


@query("f12_zip_user_function", "SELECT p_partkey, round(greatest(p_retailprice, p_size * 50.0), 6) AS y FROM part")
def f12u(spark, d):
    import numpy as np

    return table(spark, d, "part").select("p_partkey", F.round(scalars.zip_func(np.max, "p_retailprice", F.col("p_size") * 50.0), 6).alias("y"))


@query("f13_squarest", "SELECT p_partkey, a, p_partkey // a AS b FROM (SELECT p_partkey, list_max(list_filter(range(1, greatest(floor(sqrt(p_partkey))::bigint, 1) + 1), lambda i: p_partkey % i = 0)) AS a FROM part WHERE p_partkey > 0)")
def f13(spark, d):
    return table(spark, d, "part").where("p_partkey > 0").select("p_partkey", scalars.squarest_factors("p_partkey").alias("f")).select("p_partkey", "f.a", "f.b")


@query("x1_slugify", r"SELECT p_partkey, regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[\W_]+', '-', 'g') AS slug FROM part")
def x1(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.slugify(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@query("x2_fmt", "SELECT p_partkey, CASE WHEN length(p_brand) >= 10 THEN p_brand ELSE lpad(p_brand, 10, ' ') END AS r, CASE WHEN length(p_name) >= 30 THEN p_name ELSE rpad(p_name, 30, ' ') END AS l FROM part")
def x2(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.fmt("p_brand", "($%6.3fM)").alias("r"), strings.fmt("p_name", "%30s", "left").alias("l"))


@query("x5_fmt_list", "SELECT n_nationkey, printf('%05d', n_nationkey) || ';' || printf('%05d', n_regionkey) AS s FROM nation")
def x5(spark, d):
    return table(spark, d, "nation").select("n_nationkey", strings.fmt_list(F.array(F.col("n_nationkey"), F.col("n_regionkey")), "%05d", ";").alias("s"))


_TEXTS = "CASE p_partkey % 6 WHEN 0 THEN p_partkey::varchar WHEN 1 THEN '-1.5e' || (p_partkey % 9) WHEN 2 THEN 'True' WHEN 3 THEN 'None' WHEN 4 THEN '.' || p_partkey ELSE p_name END"


def _texts(spark, d):
    k = F.col("p_partkey")
    s = F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, F.concat(F.lit("-1.5e"), (k % 9).cast("string"))).when(k % 6 == 2, F.lit("True")).when(k % 6 == 3, F.lit("None")).when(k % 6 == 4, F.concat(F.lit("."), k.cast("string"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", s.alias("s"))


@query("x6_infer_type", f"SELECT p_partkey, CASE WHEN try_cast(s AS BIGINT) IS NOT NULL AND s NOT LIKE '%.%' AND s NOT LIKE '%e%' THEN 'int' WHEN s NOT IN ('True', 'None') AND try_cast(s AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END AS kind FROM (SELECT p_partkey, {_TEXTS} AS s FROM part)")
def x6(spark, d):
    return _texts(spark, d).select("p_partkey", strings.infer_type("s").alias("kind"))


@query("x7_convert_type", f"SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN s::bigint END AS i, CASE WHEN p_partkey % 6 IN (1, 4) THEN s::double END AS f, CASE WHEN p_partkey % 6 = 2 THEN true END AS b, CASE WHEN p_partkey % 6 = 5 THEN s END AS s FROM (SELECT p_partkey, {_TEXTS} AS s FROM part)")
def x7(spark, d):
    return _texts(spark, d).select("p_partkey", strings.convert_type("s").alias("c")).select("p_partkey", "c.i", "c.f", "c.b", "c.s")


@query("x8_key_values", "SELECT n_nationkey, 'K' || n_regionkey AS a, n_name AS b FROM nation")
def x8(spark, d):
    made = F.concat(F.lit("a=K"), F.col("n_regionkey").cast("string"), F.lit(";b="), "n_name")
    return table(spark, d, "nation").select("n_nationkey", strings.key_values(made, ";").alias("m")).select("n_nationkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("x11_abbrev", "SELECT doc_id, CASE WHEN length(text) <= 30 THEN text ELSE substr(text, 1, 9) || '...' || right(text, 18) END AS s FROM documents")
def x11(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.abbrev("text", 30).alias("s"))


@query("x12_replace_ext", r"SELECT page_id, CASE WHEN contains(url, '.') THEN regexp_replace(url, '\.[^.]*$', '.txt') ELSE url || '.txt' END AS s FROM pages")
def x12(spark, d):
    return table(spark, d, "pages").select("page_id", strings.replace_ext("url", "txt").alias("s"))


@query("x13_url_basename", r"SELECT page_id, CASE WHEN b = '' THEN 'index' ELSE b END AS s FROM (SELECT page_id, regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS b FROM pages)")
def x13(spark, d):
    return table(spark, d, "pages").select("page_id", strings.url_basename("url").alias("s"))
