"""Rolling full and multivariate statistics against groups of copied rows, at small and large windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import multivariate, quantiles, rolling, stats, windows


def series(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = r.choice([None, float("nan"), 1.0, 2.0, 2.0, r.gauss(5, 3), r.gauss(1e3, 1), -0.5])
        w = r.choice([None, 0.0, -1.0, 1.0, 1.0, 2.5, r.random()])
        rows.append((i, x, w, r.choice([None, r.gauss(0, 1), 3.0])))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(series(233), "pos long, x double, w double, y double").repartition(3).cache()


def close(a, b):
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) and (b is None or b != b)
    return a == b if isinstance(a, (int, str)) else abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))


def compare(got, want, keys):
    """Rows equal by key, in all columns of `want`."""
    assert sorted(got.columns) == sorted(want.columns)
    table = {tuple(r[k] for k in keys): r for r in got.collect()}
    rows = want.collect()
    assert len(rows) == len(table)
    for r in rows:
        mine = table[tuple(r[k] for k in keys)]
        for c in want.columns:
            assert close(mine[c], r[c]), (c, mine[c], r[c], r)


def by_groups(df, n, size, offset, weight):
    """What the library's grouped statistics give over rows copied into every window."""
    placed = windows.in_windows(df, "pos", n, size, offset)
    ends = placed.groupBy("window").agg(*[c.alias(k) for k, c in stats.extremes("x", "pos", weight).items()])
    names = ("size", "count", *rolling._MOMENTS)
    return stats.full_summary(placed, "x", weight, by=["window"], statistics=names).join(ends, "window")


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("size,offset", [(7, 3), (1, 1), (50, 1), (233, 10), (100, 33)])
def test_full(rows, size, offset, weight, monkeypatch):
    monkeypatch.setattr(rolling, "LEAST_CHUNK", 16)
    got = rolling.rolling_summary(rows, "pos", "x", weight, size=size, offset=offset)
    compare(got, by_groups(rows, 233, size, offset, weight), ["window"])


@pytest.mark.parametrize("full", [True, False])
def test_windows_beyond_a_task_are_groups(rows, full):
    small = rolling.rolling_summary(rows, "pos", "x", "w", size=60, offset=20, full=full)
    compare(rolling.rolling_summary(rows, "pos", "x", "w", size=60, offset=20, full=full, chunk_rows=30), small, ["window"])


@pytest.mark.parametrize("size,offset,chunk", [(9, 4, 1 << 20), (1, 2, 1 << 20), (120, 1, 1 << 20), (120, 30, 50)])
def test_multivariate(rows, size, offset, chunk, monkeypatch):
    monkeypatch.setattr(rolling, "LEAST_CHUNK", 16)
    got = rolling.rolling_multivariate(rows, "pos", ["x", "y"], "w", size=size, offset=offset, chunk_rows=chunk)
    want = multivariate.multivariate(windows.in_windows(rows, "pos", 233, size, offset), ["x", "y"], "w", ["window"])
    columns = ["window", "i", "j", "count", "mean_wt", "d_count", "mean", "sum"]
    compare(got.select(columns), want.select(columns), ["window", "i", "j"])
    for a, b in zip(got.orderBy("window", "i", "j").collect(), want.orderBy("window", "i", "j").collect(), strict=True):
        for c in ("variance", "multiple"):
            assert (a[c] is None) == (b[c] is None)
            assert a[c] is None or abs(a[c] - b[c]) <= 1e-6 * max(1.0, abs(b[c]))


def test_a_steep_series_does_not_cancel(spark):
    """Values near 1e8 that rise by 1 a row: each window's variance is that of consecutive numbers."""
    df = spark.range(40_000).select(F.col("id").alias("pos"), (F.col("id") + 1e8).alias("x"), (2.0 * F.col("id")).alias("y"))
    got = rolling.rolling_multivariate(df, "pos", ["x", "y"], size=100, offset=5000)
    want = (100**2 - 1) / 12
    for r in got.where("i = 'x'").collect():
        assert abs(r["variance"] - want * (2 if r["j"] == "y" else 1)) < 1e-4 * want
    full = rolling.rolling_summary(df, "pos", "x", size=100, offset=5000, full=False)
    assert all(abs(r["variance"] - want) < 1e-6 * want for r in full.collect())


def test_rows_are_written_twice_at_most(spark):
    df = spark.range(100_000).select(F.col("id").alias("_pos"))
    for size in (10, 10_000, 16_384, 50_000):
        chunk = max(size, rolling.LEAST_CHUNK)
        assert rolling._in_chunks(df, "_pos", size, chunk).count() < 200_000


def test_options_of_the_window(rows):
    shares = rolling.rolling_summary(rows, "pos", "x", size=0.1, overlap=2, fit_edges=False, full=False)
    assert {r["size"] for r in shares.collect()} == {23}
    fitted = rolling.rolling_summary(rows, "pos", "x", size=0.1, overlap=2, full=False).collect()
    size, step = windows.size_offset(233, 0.1, 2, True)
    assert {r["size"] for r in fitted} == {size} and max(r["window"] for r in fitted) * step + size == 233
    assert rolling.rolling_summary(rows, "pos", "x", size=500, offset=1).count() == 0
    assert rolling.rolling_summary(rows.where("false"), "pos", "x", size=5, offset=1).count() == 0
    with pytest.raises(ValueError):
        rolling.rolling_summary(rows, "pos", "x", size=0.0001, offset=1)


def test_nearest(rows):
    x, y = rolling.nearest_summary(rows, "x", "y", "pos", y_weight="w", size=40, overlap=4, fit_edges=False)
    sorted_rows = sorted((r for r in series(233) if r[1] is not None and r[1] == r[1]), key=lambda r: (r[1], r[0]))
    first = [r for r in sorted_rows[:40] if r[2] is not None and r[2] > 0]
    r = x.where("window = 0").first()
    assert r["count"] == len(first) and r["min"] == min(v[1] for v in first)
    both = rolling.nearest_summary(rows, "x", ["x", "y"], "pos", "w", size=40, overlap=4, fit_edges=False)[1]
    assert both.where("window = 0 AND i = 'x' AND j = 'x'").first()["count"] == len(first)
    assert y.count() == x.count() == (len(sorted_rows) - 40) // 10 + 1


def test_sorted_quantiles_are_hazen(spark):
    r = np.random.default_rng(0)
    x = np.sort(r.normal(size=(20, 11)), axis=1)
    got = rolling.sorted_quantiles(x, np.ones_like(x), quantiles.PERCENTILES)
    want = np.quantile(x, quantiles.PERCENTILES, axis=1, method="hazen")
    assert np.allclose(got, want)
