"""Queries of dates, calendars, geometry, neighbours, sampling, sets and prefixes, with oracles where SQL can tell."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions import dates
from paneloom.operators import neighbors, sampling, sets, spatial, userdefined
from paneloom.operators.calendar import Calendar, calendar_from

from .catalog_stats import NINE, sql_quantiles
from .registry import query as _query
from .tables import table

#: Date columns of results; both sides give them as text.
_DATES = {"s16": ["cal_date"], "c5": ["p", "r"], "c6": ["p", "n", "b"], "c7": ["p", "n", "b"], "c8": ["p", "r"], "c9": ["p"], "c10": ["a"], "c11": ["p", "n", "b"], "c12": ["p", "n", "b"], "c13": ["p", "n", "b"]}


def query(name, oracle=None):
    shown = _DATES.get(name.split("_")[0], [])
    if not shown:
        return _query(name, oracle)

    def register(build):
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in shown)}) FROM ({oracle})"
        return _query(name, sql)(lambda spark, d: build(spark, d).withColumns({c: F.col(c).cast("string") for c in shown}))

    return register


@query("c2_decimalize", "SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS d, round(year(o_orderdate) + (month(o_orderdate) - 1) / 12.0::double + day(o_orderdate) / 31.0::double / 12, 8) AS y FROM orders")
def c2(spark, d):
    days = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("d")).distinct()
    return days.select("d", F.round(dates.decimalize("d"), 8).alias("y"))


@query("c3_weekday", "SELECT CAST(isodow(o_orderdate) - 1 AS INTEGER) AS w, count(*) AS n FROM orders GROUP BY 1")
def c3(spark, d):
    s = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, d, "orders").groupBy(dates.dt(s, "weekday").alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query("c4_days_since", "SELECT o_orderkey, CAST(o_orderdate::date - DATE '1995-01-01' AS INTEGER) AS n FROM orders")
def c4(spark, d):
    s = F.concat(F.date_format("o_orderdate", "d/MMM/yyyy"), F.lit(":10:00:00"))
    return table(spark, d, "orders").select("o_orderkey", dates.days_since(s, "1/Jan/1995").alias("n"))


_CAL = "cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS o FROM (SELECT DISTINCT o_orderdate::date AS d FROM orders WHERE dayofmonth(o_orderdate) % 3 <> 0)), pr AS (SELECT DISTINCT l_shipdate::date AS p FROM lineitem)"


def _cal(spark, d):
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).withColumn("tag", F.when(F.dayofmonth("d") % 3 == 0, F.lit("closed")).otherwise(F.lit("open")))
    return Calendar(calendar_from(orders, "d", "tag", skip_tag="closed")), table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("p")).distinct()


@query("s16_calendar", f"WITH {_CAL} SELECT d AS cal_date, CAST(o AS INTEGER) AS ordinal FROM cal WHERE d >= DATE '1993-01-01'", )
def s16(spark, d):
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).withColumn("tag", F.when(F.dayofmonth("d") % 3 == 0, F.lit("closed")).otherwise(F.lit("open")))
    return calendar_from(orders, "d", "tag", select_tag="open").where("cal_date >= DATE '1993-01-01'")



@query("c5_search_offset", f"WITH {_CAL}, a AS (SELECT pr.p, coalesce(max(cal.o), -1) AS o FROM pr LEFT JOIN cal ON cal.d <= pr.p GROUP BY pr.p) SELECT a.p, cal.d AS r FROM a LEFT JOIN cal ON cal.o = greatest(a.o - 5, 0)")
def c5(spark, d):
    cal, probes = _cal(spark, d)
    return cal.search(probes, "p", -5, clip_old=True, name="r")


@query("c6_next_previous", f"WITH {_CAL} SELECT p, (SELECT min(d) FROM cal WHERE d > p) AS n, (SELECT max(d) FROM cal WHERE d < p) AS b FROM pr")
def c6(spark, d):
    cal, probes = _cal(spark, d)
    return cal.previous_date(cal.next_date(probes, "p", "n"), "p", "b")


@query("c7_next_valid", f"WITH {_CAL} SELECT p, (SELECT min(d) FROM cal WHERE d >= p) AS n, (SELECT max(d) FROM cal WHERE d <= p) AS b FROM pr")
def c7(spark, d):
    cal, probes = _cal(spark, d)
    return cal.previous_valid(cal.next_valid(probes, "p", "n"), "p", "b")


@query("c8_next_valid_close", f"WITH {_CAL} SELECT p, CASE WHEN dayofmonth(p) % 2 = 0 THEN (SELECT min(d) FROM cal WHERE d >= p) ELSE (SELECT min(d) FROM cal WHERE d > p) END AS r FROM pr")
def c8(spark, d):
    cal, probes = _cal(spark, d)
    timed = probes.withColumn("t", F.when(F.dayofmonth("p") % 2 == 0, F.lit("15:59:59")).otherwise(F.lit("16:00:00")))
    return cal.next_valid_close(timed, "p", "t", "r").select("p", "r")


@query("c9_days_between", f"WITH {_CAL} SELECT p, CAST((SELECT count(*) FROM cal WHERE d <= p) - (SELECT count(*) FROM cal WHERE d <= DATE '1996-06-15') AS INTEGER) AS days FROM pr")
def c9(spark, d):
    cal, probes = _cal(spark, d)
    return cal.days_between(probes.withColumn("q", F.lit("1996-06-15").cast("date")), "q", "p").select("p", "days")


@query("c10_dates_between", f"WITH {_CAL} SELECT a, count(*) FILTER (d < b) AS half, count(*) AS closed FROM (VALUES (DATE '1994-01-01', DATE '1994-03-01'), (DATE '1995-05-02', DATE '1995-05-20')) t(a, b) JOIN cal ON d >= a AND d <= b GROUP BY a")
def c10(spark, d):
    cal, _ = _cal(spark, d)
    spans = spark.sql("SELECT * FROM VALUES (DATE '1994-01-01', DATE '1994-03-01'), (DATE '1995-05-02', DATE '1995-05-20') AS t(a, b)")
    half = cal.dates_between(spans, "a", "b").groupBy("a").agg(F.count(F.lit(1)).alias("half"))
    return half.join(cal.dates_between(spans, "a", "b", closed=True).groupBy("a").agg(F.count(F.lit(1)).alias("closed")), "a")


@query("c11_year_first", f"WITH {_CAL} SELECT p, (SELECT min(d) FROM cal WHERE year(d) = year(p) + 1) AS n, (SELECT min(d) FROM cal WHERE year(d) = year(p) - 1) AS b FROM pr")
def c11(spark, d):
    cal, probes = _cal(spark, d)
    return cal.previous_year(cal.next_year(probes, "p", "n"), "p", "b")


_MONTHS = "(year({0}) * 12 + month({0}))"


@query("c12_month_first", f"WITH {_CAL}, f AS (SELECT {_MONTHS.format('d')} AS m, min(d) AS d FROM cal GROUP BY 1) SELECT p, n.d AS n, b.d AS b FROM pr LEFT JOIN f n ON n.m = {_MONTHS.format('p')} + 1 LEFT JOIN f b ON b.m = {_MONTHS.format('p')} - 1")
def c12(spark, d):
    cal, probes = _cal(spark, d)
    return cal.previous_month(cal.next_month(probes, "p", "n"), "p", "b")


_QUARTERS = "(year({0}) * 4 + quarter({0}))"


@query("c13_quarter_last", f"WITH {_CAL}, f AS (SELECT {_QUARTERS.format('d')} AS m, max(d) AS d FROM cal GROUP BY 1) SELECT p, n.d AS n, b.d AS b FROM pr LEFT JOIN f n ON n.m = {_QUARTERS.format('p')} + 1 LEFT JOIN f b ON b.m = {_QUARTERS.format('p')} - 1")
def c13(spark, d):
    cal, probes = _cal(spark, d)
    return cal.previous_quarter(cal.next_quarter(probes, "p", "n"), "p", "b")


@query("c1_today")
def c1(spark, d):
    return spark.range(1).select(dates.today().alias("today"))


_VEC = "embeddings"


@query("n1_minkowski", f"SELECT a.vec_id AS i, b.vec_id AS j, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))), 5) AS d FROM (SELECT * FROM {_VEC}) a, (SELECT * FROM {_VEC}) b WHERE a.vec_id <> b.vec_id")
def n1(spark, d):
    return spatial.distance_matrix(table(spark, d, "embeddings"), "vec_id", "embedding", digits=5)


_NEAR = f"""WITH v AS (SELECT * FROM {_VEC}), m AS (SELECT a.vec_id AS i, b.vec_id AS j, b.label AS y, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))) AS d FROM v a, v b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM m QUALIFY r <= {{k}})"""


@query("n2_knn_stats", _NEAR.format(k=5) + " SELECT i, count(*) AS neighbours, round(avg(d), 5) AS mean_distance, round(avg(y), 5) AS mean FROM k GROUP BY i")
def n2(spark, d):
    vec = table(spark, d, "embeddings")
    near = neighbors.search(neighbors.build_index(vec, "vec_id", "embedding"), vec, "vec_id", "embedding", 5)
    got = near.join(vec.select(F.col("vec_id").alias("j"), "label"), "j").groupBy("i")
    return got.agg(F.count("j").alias("neighbours"), F.round(F.avg("d"), 5).alias("mean_distance"), F.round(F.avg("label"), 5).alias("mean"))


_NINE_OF = {p: ", ".join(f"round({n}, 5) AS {p}_{n}" for n in NINE) for p in "dy"}


@query(
    "n2_knn_full",
    _NEAR.format(k=12)
    + f""", w AS (SELECT i, j, r, d, y::double AS y, (1 + j % 3) / (1 + 0.5 * d) AS w FROM k),
dq AS (SELECT i, {_NINE_OF["d"]} FROM ({sql_quantiles("d", "w", "w", "i", NINE)})), yq AS (SELECT i, {_NINE_OF["y"]} FROM ({sql_quantiles("y", "w", "w", "i", NINE)})),
s AS (SELECT i, string_agg(j::varchar, ',' ORDER BY r) AS neighbours, count(*) AS d_count, round(sum(w * d) / sum(w), 5) AS d_mean, round(sum(w * y) / sum(w), 5) AS y_mean FROM w GROUP BY i)
SELECT i AS vec_id, s.* EXCLUDE (i), dq.* EXCLUDE (i), yq.* EXCLUDE (i) FROM s JOIN dq USING (i) JOIN yq USING (i)""",
)
def n2_full(spark, d):
    vec = table(spark, d, "embeddings").withColumn("w", 1 + F.col("vec_id") % 3)
    got = neighbors.neighbour_statistics(vec, "vec_id", "label", "embedding", 12, weight="w", reciprocal=(0.5, 1.0))
    names = [f"{p}_{n}" for p in "dy" for n in ("mean", *NINE)]
    return got.select("vec_id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"), "d_count", *[F.round(n, 5).alias(n) for n in names])


_LAT, _LON = "(c_custkey * 7 % 170 - 85)::double", "(c_custkey * 13 % 360 - 180)::double"


@query("n3_haversine", f"SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(least(pow(sin((radians(40.0) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(40.0)) * pow(sin((radians(-74.0) - radians(o)) / 2), 2), 1))), 5) AS km FROM (SELECT c_custkey, {_LAT} AS a, {_LON} AS o FROM customer)")
def n3(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 170 - 85).cast("double").alias("a"), (F.col("c_custkey") * 13 % 360 - 180).cast("double").alias("o"))
    return rows.select("c_custkey", F.round(spatial.gc_distance("a", "o", F.lit(40.0), F.lit(-74.0), True), 5).alias("km"))


@query("n4_geo_matrix", "WITH p AS (SELECT n_nationkey AS k, (n_nationkey * 7 % 170 - 85)::double AS a, (n_nationkey * 13 % 360 - 180)::double AS o FROM nation) SELECT x.k AS i, y.k AS j, round(2 * 6371.0 * asin(sqrt(least(pow(sin((radians(y.a) - radians(x.a)) / 2), 2) + cos(radians(x.a)) * cos(radians(y.a)) * pow(sin((radians(y.o) - radians(x.o)) / 2), 2), 1))), 4) AS km FROM p x, p y")
def n4(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 7 % 170 - 85).cast("double").alias("a"), (F.col("n_nationkey") * 13 % 360 - 180).cast("double").alias("o"))
    return spatial.geo_matrix(rows, "n_nationkey", "a", "o").select("i", "j", F.round("km", 4).alias("km"))


@query("n5_point_in_polygon", "SELECT p_partkey, y > 0 AND y <= 10 AND ((x > 0 AND x <= 20) OR false) AND NOT (y > 5 AND x > 10) AS inside FROM (SELECT p_partkey, (p_partkey % 23)::double AS x, (p_partkey % 11)::double AS y FROM part)")
def n5(spark, d):
    shape = [(0, 0), (20, 0), (20, 5), (10, 5), (10, 10), (0, 10)]
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 23).cast("double").alias("x"), (F.col("p_partkey") % 11).cast("double").alias("y"))
    return rows.select("p_partkey", spatial.point_in_polygon("x", "y", shape).alias("inside"))


@query("n6_density")
def n6(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    return spatial.DensityPeaks(4, bins=50, shape=(0.2, 0.1)).fit(rows, "l_quantity", "price").table(spark)


@query("y1_sample")
def y1(spark, d):
    return sampling.sample(table(spark, d, "orders"), 100, weight="o_totalprice", seed=7)


@query("y1_sample_keyed", "SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 1103515245 + 12345) % 2147483648, o_orderkey LIMIT 200")
def y1k(spark, d):
    return sampling.sample_keyed(table(spark, d, "orders"), 200, F.col("o_orderkey")).select("o_orderkey")


@query("y3_sample_each_col")
def y3(spark, d):
    return sampling.sample_each(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], 50, seed=3)


@query("y4_sample_where", "SELECT CAST(0.1 * count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' HAVING CAST(0.1 * count(*) AS BIGINT) <= 0.1 * count(*) OR true")
def y4(spark, d):
    got = sampling.sample_where(table(spark, d, "orders"), F.col("o_orderstatus") == "F", 0.1, seed=1)
    return got.agg(F.count(F.lit(1)).alias("n"))


@query("y5_sample_mask", "SELECT count(*) AS size, 40::bigint AS n FROM orders")
def y5(spark, d):
    got = sampling.sample_mask(table(spark, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "O", 40, seed=1)
    return got.agg(F.count(F.lit(1)).alias("size"), F.count_if("sampled").alias("n"))


def _kv(spark, d):
    c = table(spark, d, "customer")
    base = c.where("c_custkey % 3 <> 0").select(F.col("c_mktsegment").alias("tbl"), F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    add = c.where("c_custkey % 2 = 0").select(F.col("c_mktsegment").alias("tbl"), F.col("c_custkey").alias("key"), F.upper("c_name").alias("value"))
    return base, add


_B, _A = "SELECT c_mktsegment AS tbl, c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 3 <> 0", "SELECT c_mktsegment AS tbl, c_custkey AS key, upper(c_name) AS value FROM customer WHERE c_custkey % 2 = 0"


@query("u1_upsert", f"SELECT * FROM ({_B}) WHERE key % 2 <> 0 UNION ALL {_A}")
def u1(spark, d):
    return sets.append(*_kv(spark, d), ["tbl", "key"], overwrite=True)[0]


@query("u1_insert_absent", f"{_B} UNION ALL SELECT * FROM ({_A}) WHERE key % 3 = 0")
def u1i(spark, d):
    return sets.append(*_kv(spark, d), ["tbl", "key"])[0]


@query("u1_skipped", f"SELECT tbl, key FROM ({_A}) WHERE key % 3 <> 0")
def u1s(spark, d):
    return sets.append(*_kv(spark, d), ["tbl", "key"])[1]


@query("u2_invert", "SELECT o_custkey AS key, max(o_orderpriority) AS tbl FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def u2(spark, d):
    return sets.invert(table(spark, d, "orders").select(F.col("o_orderpriority").alias("tbl"), F.col("o_custkey").alias("key")), exclude=["5-LOW"])


@query("u3_table_sets", "SELECT n_regionkey AS tbl, string_agg(n_nationkey::varchar, ',' ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1")
def u3(spark, d):
    got = sets.table_sets(table(spark, d, "nation").select(F.col("n_regionkey").alias("tbl"), F.col("n_nationkey").alias("key")))
    return got.select("tbl", F.concat_ws(",", F.transform("keys", lambda k: k.cast("string"))).alias("keys"))


@query("u4_intersection", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def u4(spark, d):
    return table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "orders").select("o_custkey"))


@query("a34_table_counts", "SELECT o_orderstatus AS tbl, year(o_orderdate)::integer AS y, count(*) AS count FROM orders GROUP BY ALL")
def a34(spark, d):
    return sets.table_counts(table(spark, d, "orders").withColumn("tbl", F.col("o_orderstatus")), expr=F.year("o_orderdate"), name="y")


@query("a37_nested_count", "SELECT n_regionkey, 2 * count(*) AS n FROM nation GROUP BY 1")
def a37(spark, d):
    nested = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.array("n_nationkey", "n_regionkey")).alias("x"))
    return nested.select("n_regionkey", sets.nested_count(F.col("x"), 2).alias("n"))


@query(
    "z1_trie",
    """WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), d AS (SELECT w, max(p_partkey) AS idx FROM s WHERE p_partkey % 10 = 0 GROUP BY w),
p AS (SELECT w[1:k] AS pre FROM d, unnest(range(1, len(w) + 1)) AS u(k) GROUP BY 1), q AS (SELECT p_partkey, w, k FROM s, unnest(range(1, len(w) + 1)) AS u(k))
SELECT q.p_partkey, CAST(coalesce(max(CASE WHEN p.pre IS NOT NULL THEN k END), 0) AS INTEGER) AS depth, bool_or(q.w IN (SELECT w FROM d)) AS contained FROM q LEFT JOIN p ON p.pre = q.w[1:k] GROUP BY q.p_partkey""",
)
def z1(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    trie = sets.Trie(words.where("p_partkey % 10 = 0"), "w", "p_partkey")
    return trie.match(words, "p_partkey", "w").select("p_partkey", "depth").join(trie.contains(words, "w", "contained").select("p_partkey", "contained"), "p_partkey")


@query("z6_table_function", "SELECT event_id, unnest(range(event_id % 3 + 1)) AS k FROM events")
def z6(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)).alias("k"))


@query(
    "z6_table_function_of_parts",
    """WITH g AS (SELECT user_id, value, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, CAST(k - 1 AS BIGINT) AS visit, count(*) AS events, max(value) AS most FROM s GROUP BY user_id, k""",
)
def z6_parts(spark, d):
    """Visits of each user, yielded one by one as their events come in order of time."""

    class Visits:
        def __init__(self):
            self.user, self.last, self.visit, self.n, self.most = None, None, 0, 0, 0.0

        def eval(self, row):
            if self.n and row["us"] - self.last >= 6 * 3600 * 1_000_000:
                yield self.user, self.visit, self.n, self.most
                self.visit, self.n, self.most = self.visit + 1, 0, 0.0
            self.user, self.last, self.n = row["user_id"], row["us"], self.n + 1
            self.most = max(self.most, row["value"]) if self.n > 1 else row["value"]

        def terminate(self):
            if self.n:
                yield self.user, self.visit, self.n, self.most

    visits = userdefined.table_function(Visits, "user_id long, visit long, events long, most double")
    ev = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "value")
    return visits(ev, ["user_id"], ["us", "event_id"])
