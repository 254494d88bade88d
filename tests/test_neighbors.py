"""Neighbours by the index of cells against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import neighbors, spatial


def points(kind, n=260, width=6):
    r = np.random.default_rng(3)
    if kind == "clouds":
        return r.normal(size=(8, width))[r.integers(0, 8, n)] * 20 + r.normal(size=(n, width))
    if kind == "one crowd":
        return np.vstack([np.tile(r.normal(size=width), (n // 2, 1)), r.normal(size=(n - n // 2, width))])
    return r.normal(size=(n, width))


def nearest_of(x, power, weights, k, cutoff):
    y = x if weights is None else x * (np.array(weights) / sum(weights))
    d = (np.abs(y[:, None] - y) ** power).sum(2) ** (1 / power)
    np.fill_diagonal(d, np.inf)
    out = {}
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i].round(11)))[:k] if d[i, j] <= (np.inf if cutoff is None else cutoff) and d[i, j] < np.inf]
        out[i] = [(j, d[i, j]) for j in order]
    return out


def frame(spark, x):
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)]
    rows += [(-1, None), (-2, [None] * x.shape[1]), (-3, [float("nan")] * x.shape[1])]
    return spark.createDataFrame(rows, "k long, v array<double>").repartition(4)


@pytest.mark.parametrize("kind", ["clouds", "one crowd", "noise"])
@pytest.mark.parametrize("options", [{}, {"power": 1.0}, {"power": 3.0, "weights": [1, 2, 3, 0, 1, 1]}, {"power": 0.5}, {"cutoff": 1.5, "block_rows": 7}, {"k": 300}])
def test_search(spark, kind, options):
    x = points(kind).round(4)
    k, cutoff = options.get("k", 5), options.get("cutoff")
    df = frame(spark, x)
    index = neighbors.build_index(df, "k", "v", power=options.get("power", 2.0), weights=options.get("weights"), block_rows=options.get("block_rows", 50))
    assert index.rows.sum() == len(x)
    want = nearest_of(x, options.get("power", 2.0), options.get("weights"), k, cutoff)
    got = {}
    for r in neighbors.search(index, df, "k", "v", k, cutoff=cutoff).orderBy("i", "place").collect():
        got.setdefault(r["i"] // 3, []).append((r["j"] // 3, r["d"], r["place"]))
    for i, w in want.items():
        mine = got.get(i, [])
        assert [j for j, *_ in mine] == [j for j, _ in w]
        assert [p for *_, p in mine] == list(range(1, len(w) + 1))
        assert np.allclose([d for _, d, _ in mine], [d for _, d in w])
    assert set(got) <= set(want)


def test_cells_spare_most_rows(spark):
    """In clouds far apart a query is compared with its own cloud alone."""
    x = points("clouds", 2000)
    df = frame(spark, x)
    index = neighbors.build_index(df, "k", "v", cells=40)
    asked = neighbors._scaled(df, "k", "v").withColumn("bound", F.lit(4.0))
    pairs = sum(len(r["ids"]) // 8 * index.rows[r["cell"]] for r in neighbors._asked(index, asked, 5, False).collect())
    pairs += sum(len(r["ids"]) // 8 * index.rows[r["cell"]] for r in neighbors._asked(index, asked, 5, True).collect())
    assert pairs < 0.3 * len(x) ** 2


def test_what_is_asked_is_not_broadcast(spark):
    """Queries are few, but each is asked of many cells: that goes by a shuffle, not through the driver."""
    df = frame(spark, points("noise"))
    index = neighbors.build_index(df, "k", "v")
    for first in (True, False):
        asked = neighbors._scaled(df, "k", "v").withColumn("bound", F.lit(9.0))
        plan = neighbors._look(index, neighbors._asked(index, asked, 5, first), 5)._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_search_of_few_rows(spark):
    one = spark.createDataFrame([(1, [0.0, 0.0])], "k long, v array<double>")
    none = one.where("false")
    assert neighbors.search(neighbors.build_index(one, "k", "v"), one, "k", "v", 3).count() == 0
    assert neighbors.search(neighbors.build_index(none, "k", "v"), one, "k", "v", 3).count() == 0
    assert neighbors.search(neighbors.build_index(one, "k", "v"), none, "k", "v", 3).count() == 0
    other = spark.createDataFrame([(2, [3.0, 4.0])], "k long, v array<double>")
    assert [tuple(r) for r in neighbors.search(neighbors.build_index(one, "k", "v"), other, "k", "v", 3).collect()] == [(2, 1, 5.0, 1)]


def test_statistics(spark):
    x = points("noise", 120, 3).round(3)
    y = [None if i % 7 == 0 else float(i % 11) for i in range(len(x))]
    w = [None if i % 13 == 0 else float(i % 5) for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), y[i], w[i]) for i, v in enumerate(x)], "k long, v array<double>, y double, w double")
    got = neighbors.neighbour_statistics(df, "k", "y", "v", 6, weight="w", reciprocal=(2.0, 1.5), cutoff=1.2, queries=F.col("k") % 4 == 0)
    near = nearest_of(x, 2.0, None, 6, 1.2)
    rows = {r["k"]: r for r in got.collect()}
    assert sorted(rows) == [i for i in range(len(x)) if i % 4 == 0]
    for i, r in rows.items():
        assert r["neighbours"] == [j for j, _ in near[i]]
        held = [(d, y[j], w[j] / (1 + 2 * d) ** 1.5) for j, d in near[i] if w[j]]
        if not near[i]:
            assert r["d_count"] is None and r["y_mean"] is None
            continue
        assert r["d_size"] == len(near[i]) and r["d_count"] == len(held)
        known = [(v, u) for _, v, u in held if v is not None]
        assert r["y_count"] == len(known)
        if held:
            assert r["d_mean"] == pytest.approx(sum(d * u for d, _, u in held) / sum(u for *_, u in held))
        if known:
            assert r["y_mean"] == pytest.approx(sum(v * u for v, u in known) / sum(u for _, u in known))
        if len(held) > 1:
            order = sorted((d, u) for d, _, u in held)
            total, upto, before = sum(u for _, u in order), 0.0, None
            t = 0.5 * total + total / len(order) / 2
            for d, u in order:
                upto += u
                if upto >= t:
                    want = d if before is None else before + (d - before) * (t - (upto - u)) / u
                    break
                before = d
            assert r["d_median"] == pytest.approx(want)


@pytest.mark.parametrize("options", [{}, {"power": 1.0, "weights": [1, 2, 3, 0, 1, 1]}, {"power": 3.0}])
def test_distance_matrix_in_blocks(spark, options):
    """All pairs both ways from blocks that meet in a product: no broadcast, nothing shuffled as pairs."""
    x = points("noise", 61).round(4)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [None] * 6), (-3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k long, v array<float>").repartition(3)
    got = spatial.distance_matrix(df, "k", "v", block=7, digits=5, **options)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan
    found = {(r["i"], r["j"]): r["d"] for r in got.collect()}
    assert got.count() == len(found) == len(rows) * (len(rows) - 1)
    power, weights = options.get("power", 2.0), options.get("weights")
    z = np.array([r[1] for r in rows[:-3]], np.float32).astype(float) * (1 if weights is None else np.array(weights) / sum(weights))
    d = (np.abs(z[:, None] - z) ** power).sum(2) ** (1 / power)
    for (i, j), v in found.items():
        if i < 0 or j < 0:
            assert v is None
        else:
            assert abs(v - d[i // 3, j // 3]) <= 5.1e-6 and v == round(v, 5)


@pytest.mark.parametrize("kind", ["clouds", "one crowd", "noise"])
@pytest.mark.parametrize("options", [{}, {"power": 1.0}, {"power": 3.0, "weights": [1, 2, 3, 0, 1, 1]}, {"power": 0.5}, {"cutoff": 1.5, "block_rows": 7}, {"k": 300}])
def test_search_by_a_product_of_blocks(spark, kind, options, monkeypatch):
    """The second look by blocks of queries and of rows in several parts finds what the one by cells does."""
    monkeypatch.setattr(neighbors, "_SHUFFLED_CELLS", -1)
    monkeypatch.setattr(neighbors, "_QUERY_ROWS", 37)
    monkeypatch.setattr(neighbors, "_PART_BYTES", 4096)
    test_search(spark, kind, options)


def test_queries_of_many_cells_are_not_written_for_each(spark, monkeypatch):
    """In noise every query is left nearly all cells: it is kept once, in a block."""
    df = frame(spark, points("noise", 1000, 24))
    index = neighbors.build_index(df, "k", "v")
    called = []
    look = neighbors._look
    monkeypatch.setattr(neighbors, "_look", lambda *a: called.append(1) or look(*a))
    got = neighbors.search(index, df, "k", "v", 5)
    assert called == [1] and got.count() == 5000
    assert "CartesianProduct" in got._jdf.queryExecution().toString()


def test_all_vectors_have_full_statistics(spark):
    """n2_knn_full asks for the neighbours of every row of its table."""
    from paneloom.plans import registry

    sf = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = {r["vec_id"]: r["neighbours"] for r in registry.queries()["n2_knn_full"](spark, sf).collect()}
    x = np.array([r["embedding"] for r in vectors], float)
    near = nearest_of(x, 2.0, None, 12, None)
    assert got == {r["vec_id"]: ",".join(str(vectors[j]["vec_id"]) for j, _ in near[p]) for p, r in enumerate(vectors)}
    assert "% 20" not in registry.oracles()["n2_knn_full"]


def test_all_vectors_have_means_of_their_neighbours(spark):
    """n2_knn_stats asks for the neighbours of every row of its table."""
    from paneloom.plans import registry

    sf = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = {r["i"]: (r["neighbours"], r["mean_distance"], r["mean"]) for r in registry.queries()["n2_knn_stats"](spark, sf).collect()}
    near = nearest_of(np.array([r["embedding"] for r in vectors], float), 2.0, None, 5, None)
    assert len(got) == len(vectors) and "% 20" not in registry.oracles()["n2_knn_stats"]
    for p, r in enumerate(vectors):
        assert got[r["vec_id"]] == (5, pytest.approx(np.mean([d for _, d in near[p]]), abs=1e-5), pytest.approx(np.mean([vectors[j]["label"] for j, _ in near[p]]), abs=1e-5))


def test_both_ways_of_a_pair_are_near_each_other(spark):
    """Rows of two blocks come in short turns of both ways, so that a file holds their distances about once."""
    x = points("noise", 120).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").coalesce(1)
    at = {(r["i"], r["j"]): p for p, r in enumerate(spatial.distance_matrix(df, "k", "v", block=60).collect())}
    assert len(at) == 120 * 119
    assert all(abs(p - at[j, i]) <= 128 for (i, j), p in at.items() if i // 60 != j // 60)
