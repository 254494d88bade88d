"""Missing values, weights, quantiles and distributed running sums against independent numpy restatements."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paneloom.functions import missing, scalars
from paneloom.operators import multivariate, quantiles, regress, stats
from paneloom.plans import ranking, shared

NAN = float("nan")


def frame(spark, rows, schema="id long, g string, x double, w double"):
    return spark.createDataFrame(rows, schema)


def test_missing_and_weights(spark):
    df = frame(spark, [(0, "a", 1.0, 2.0), (1, "a", NAN, 1.0), (2, "a", None, 1.0), (3, "a", 3.0, 0.0), (4, "a", 5.0, -1.0), (5, "a", 4.0, NAN), (6, "a", 2.0, 1.0), (7, "b", None, 1.0), (8, "c", 7.0, 1.0)])
    got = {r["g"]: r for r in stats.summary(df, "x", "w", by=["g"]).collect()}
    assert (got["a"]["size"], got["a"]["count"]) == (7, 2)
    assert got["a"]["mean"] == pytest.approx(4 / 3)
    assert got["a"]["sum"] == pytest.approx(8 / 3)
    assert got["a"]["variance"] == pytest.approx(2 / 9)
    assert got["a"]["d_count"] == pytest.approx(9 / 5)
    assert (got["b"]["count"], got["b"]["mean"]) == (0, None)
    assert (got["c"]["mean"], got["c"]["variance"]) == (7.0, None)


def test_variance_does_not_cancel(spark):
    df = frame(spark, [(i, "a", 1e8 + i, 1.0 + i) for i in range(3)])
    r = stats.summary(df, "x", "w").first()
    w = np.array([1.0, 2.0, 3.0])
    mu = (w * np.arange(3)).sum() / w.sum()
    assert r["variance"] == pytest.approx((w * (np.arange(3) - mu) ** 2).sum() / w.sum(), rel=1e-6)


def test_bins_send_missing_to_other(spark):
    df = frame(spark, [(0, "", NAN, 1.0), (1, "", None, 1.0), (2, "", 1.0, 1.0), (3, "", 2.0, 1.0), (4, "", 9.0, 1.0)])
    got = [r[0] for r in df.orderBy("id").select(stats.bin_label("x", [2, 5])).collect()]
    assert got == ["Other", "Other", "_2", "2_5", "5_"]


def reference_quantile(x, w, q):
    order = np.lexsort((w, x))
    x, w = x[order], w[order]
    c = np.cumsum(w)
    t = q * c[-1] + c[-1] / len(x) / 2
    hit = np.flatnonzero(c >= t)
    if not len(hit):
        return x[-1]
    i = hit[0]
    if i == 0:
        return x[0]
    return ((c[i] - t) * x[i - 1] + (t - c[i - 1]) * x[i]) / (c[i] - c[i - 1])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(0, 5)), min_size=2, max_size=25))
def test_weighted_quantiles(spark, pairs):
    rows = [(i, "a", float(x), float(w)) for i, (x, w) in enumerate(pairs)]
    kept = [(x, w) for _, _, x, w in rows if w > 0]
    if len(kept) < 2:
        return
    x, w = np.array(kept).T
    got = quantiles.weighted_quantiles(frame(spark, rows), "x", "w", quantiles=[0.5, 0.9, 0.05]).first()
    for q in (0.5, 0.9, 0.05):
        assert got[quantiles.percentile_name(q)] == pytest.approx(reference_quantile(x, w, q), abs=1e-9)


def test_lone_value_has_only_a_median(spark):
    r = quantiles.weighted_quantiles(frame(spark, [(0, "a", 3.0, 1.0)]), "x", "w", quantiles=[0.5, 0.9], mad=True).first()
    assert (r["median"], r["p90"], r["mad"]) == (3.0, None, None)


def test_distributed_running_sum_equals_one_window(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 101).alias("x"))
    order = [F.col("x"), F.col("id")]
    for by in ([], ["g"]):
        one = ranking.running(df, by, order, {"s": F.col("x")}, distributed=False)
        many = ranking.running(df, by, order, {"s": F.col("x")}, distributed=True)
        assert sorted(map(tuple, one.select("id", "s").collect())) == sorted(map(tuple, many.select("id", "s").collect()))
    at = ranking.global_ordinal(df, order).select("id", "pos").collect()
    want = {i: p for p, (_, i) in enumerate(sorted((i * 37 % 101, i) for i in range(1000)))}
    assert {r["id"]: r["pos"] for r in at} == want


def test_checked_broadcast_has_another_way(spark, monkeypatch):
    small = spark.range(100).withColumnRenamed("id", "k")
    big = spark.range(1000).select((F.col("id") % 100).alias("k"))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 10)
    assert big.join(shared.checked_broadcast(small), "k").count() == 1000


def test_marginal_covariance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0), (None, 4.0), (5.0, 9.0)], "a double, b double")
    got = {(r["i"], r["j"]): r for r in multivariate.multivariate(df, ["a", "b"]).collect()}
    assert got[("a", "b")]["variance"] == pytest.approx(5.666667, abs=1e-6)
    assert got[("a", "b")]["count"] == 3
    shifted = {(r["i"], r["j"]): r for r in multivariate.multivariate(df, ["a", "b"], shifts=[3.0, 4.0]).collect()}
    for k in got:
        assert shifted[k]["variance"] == pytest.approx(got[k]["variance"])
        assert shifted[k]["multiple"] == pytest.approx(got[k]["multiple"])


def test_exact_fit(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), 1 + 2.0 * i - i * i % 7) for i in range(12)], "a double, b double, y double")
    r = regress.regress(df, "y", ["a", "b"]).first()
    assert (round(r["constant"], 6), round(r["a"], 6), round(r["b"], 6)) == (1.0, 2.0, -1.0)
    assert r["R2"] == pytest.approx(1.0)
    assert r["residual_squares"] == pytest.approx(0.0, abs=1e-9)


def test_missing_predictor_adds_nothing(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "a double, y double")
    fits = regress.fit(df, "y", ["a"])
    gap = spark.createDataFrame([(None,)], "a double")
    assert regress.forecast(gap, fits, ["a"]).first()["predicted"] == pytest.approx(1.0)
    assert regress.forecast(gap, fits, ["a"], drop_missing=True).first()["predicted"] is None


def test_zip_min_keeps_missing(spark):
    df = spark.createDataFrame([(-1.5,), (2.4,), (5.1,), (9.8,), (NAN,)], "a double")
    got = [r[0] for r in df.select(scalars.zip_reduce("min", "a", F.col("a") + 0.01, 5)).collect()]
    assert got == [-1.5, 2.4, 5.0, 5.0, None]


def test_export_nan(spark):
    assert math.isnan(spark.createDataFrame([(None,)], "a double").select(missing.export_nan("a")).first()[0])


def test_step_list_starts(spark):
    got = [r[0] for r in spark.range(12).select(stats.clump_start("id", [2, 3])).collect()]
    assert got == [0, 0, 2, 2, 2, 5, 5, 5, 8, 8, 8, 11]
    assert [r[0] for r in spark.range(8).select(stats.clump("id", [2, 3])).collect()] == [0, 0, 1, 1, 1, 2, 2, 2]


def test_gini(spark):
    df = spark.createDataFrame([(3.0, 1.0), (2.0, 4.0), (5.0, 9.0)], "n double, m double")
    assert stats.gini(df, "n", "m").first()[0] == pytest.approx(0.3357142857)


def test_neighbours_cover_the_whole_table(spark):
    from paneloom.operators import spatial

    r = np.random.default_rng(3)
    x = np.vstack([r.normal(size=(230, 6)), np.tile(r.normal(size=6), (40, 1))]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>").repartition(4)
    for power in (2.0, 1.0):
        d = (np.abs(x[:, None] - x) ** power).sum(2) ** (1 / power)
        np.fill_diagonal(d, np.inf)
        want = {(3 * i, p + 1): 3 * j for i in range(len(x)) for p, j in enumerate(np.lexsort((np.arange(len(x)), d[i].round(12)))[:5])}
        got = spatial.nearest(df, "k", "v", 5, power=power, block=50).collect()
        assert {(g["i"], g["place"]): g["j"] for g in got} == want
        assert all(abs(g["d"] - d[g["i"] // 3, g["j"] // 3]) < 1e-9 for g in got)


def test_vector_queries_cover_the_whole_table(spark):
    from paneloom.plans import registry

    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert registry.queries()["n1_minkowski"](spark, "/root/testdata/sf0.001").count() == n * (n - 1)
    assert registry.queries()["n2_knn_stats"](spark, "/root/testdata/sf0.001").count() == -(-n // 20)


def test_segments_cover_all_rows(spark):
    from paneloom.operators import joins
    from paneloom.plans import registry

    df = spark.range(10)
    got = {r["id"]: r["segment"] for r in joins.segments(df, "id", [3, 0, 5, 2]).collect()}
    assert got == dict(enumerate([0, 0, 0, 2, 2, 2, 2, 2, 3, 3]))
    for lengths in ([3, 5], [3, 5, 3]):
        with pytest.raises(ValueError):
            joins.segments(df, "id", lengths)
    assert joins.repeated_lengths(10, [3, 4]) == [3, 4, 3] and joins.repeated_lengths(0, [3]) == []
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert registry.queries()["j9_sincat"](spark, sf).agg(F.sum("n")).first()[0] == n
    assert registry.queries()["z4_user_function"](spark, sf).count() == len(joins.repeated_lengths(n, [100, 200]))


def test_autocorrelation_has_all_lags(spark):
    from paneloom.operators import windows

    x = np.random.default_rng(4).normal(size=41)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "p long, x double")
    got = {r["lag"]: r["corr"] for r in windows.autocorrelation(df, "p", "x").collect()}
    assert sorted(got) == list(range(1, 21))
    assert all(got[k] == pytest.approx(np.corrcoef(x[:-k], x[k:])[1, 0]) for k in got)
    assert windows.autocorrelation(df.limit(1), "p", "x").count() == 0


def test_event_queries_cover_all_rows(spark):
    from paneloom.plans import registry

    sf = "/root/testdata/sf0.001"
    value = {r["event_id"]: r["value"] for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    got = registry.queries()["z6_table_function"](spark, sf).collect()
    assert sorted((r["event_id"], r["k"]) for r in got) == sorted((i, k) for i in value for k in range(i % 3 + 1))
    got = {r["k"]: r["value"] for r in registry.queries()["w12_interp"](spark, sf).collect()}
    assert sorted(got) == sorted(i for i in value if i + 1 in value)
    assert all(got[i] == pytest.approx(0.75 * value[i] + 0.25 * value[i + 1], abs=1e-6) for i in got)
