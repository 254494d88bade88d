"""Interval sweeps, segments of any lengths and autocorrelation at all lags against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import joins, spectral
from paneloom.plans import ranking


@pytest.fixture(params=[64 << 20, 0], ids=["one window", "ranges"])
def window_bytes(request, monkeypatch):
    """Ordinals and running sums by one window, and by ranges as for large tables."""
    monkeypatch.setattr(ranking, "ONE_WINDOW_BYTES", request.param)
    import paneloom.operators.relational as relational

    monkeypatch.setattr(relational, "ONE_WINDOW_BYTES", request.param)


def overlaps(a, b):
    out = []
    for (i, alo, ahi), (j, blo, bhi) in itertools.product(a, b):
        if None in (alo, ahi, blo, bhi) or alo > ahi or blo > bhi or max(alo, blo) > min(ahi, bhi):
            continue
        before = next((h for k, _, h in sorted(a, reverse=True) if k < i), None)
        if before is not None and before == bhi == alo:
            continue
        out.append((max(alo, blo), min(ahi, bhi), i, j))
    return sorted(out)


@pytest.mark.parametrize("slot", [1, 3, 4096])
def test_intervals_against_brute_force(spark, window_bytes, slot):
    r = random.Random(slot)
    for case in range(2):
        lists = []
        for n in (40, 55):
            starts = [float(r.randint(0, 30)) for _ in range(n)]
            lists.append([(i, s, s + r.choice([0, 0, 1, 3, 40, -1])) for i, s in enumerate(starts)])
        lists[0].append((99, 0.0, 1000.0))  # over everything
        lists[1] += [(77, None, 3.0), (78, 3.0, None)]
        if case:
            lists[0] = [(i, 5.0, 5.0) for i in range(30)]  # one start for all
        a, b = (spark.createDataFrame(x, "idx int, lo double, hi double").repartition(3) for x in lists)
        got = sorted(tuple(r) for r in joins.intersect_intervals(a, b, slot=slot).collect())
        assert got == overlaps(*lists)


def test_one_interval_over_a_million(spark):
    a = spark.createDataFrame([(0, -1.0, 1e9)], "idx long, lo double, hi double")
    b = spark.range(1_000_000).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("lo"), (F.col("id") + 0.5).alias("hi"))
    got = joins.intersect_intervals(a, b)
    assert got.agg(F.count(F.lit(1)), F.sum("j"), F.count_distinct("j")).first()[:] == (1_000_000, 999_999 * 500_000, 1_000_000)


def test_intervals_of_empty_lists(spark):
    none = spark.createDataFrame([], "idx int, lo double, hi double")
    some = spark.createDataFrame([(0, 1.0, 2.0)], "idx int, lo double, hi double")
    assert joins.intersect_intervals(none, some).count() == joins.intersect_intervals(some, none).count() == 0


@pytest.mark.parametrize("reverse", [False, True])
def test_segments(spark, window_bytes, reverse):
    lengths, overlay = [3, 0, 5, 1, 0, 4, 0], [True, True, False, True, False, None, True]
    df = spark.range(13).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("v")).repartition(4)
    got = {r["pos"]: (r["segment"], r["place"], r["v"]) for r in joins.segments(df, "pos", lengths, overlay=overlay, reverse=reverse).collect()}
    want, at = {}, 0
    for s, n in enumerate(lengths):
        for k in range(n):
            if overlay[s]:
                want[at] = (s, n - 1 - k if reverse else k, 2 * at)
            at += 1
    assert got == want


def test_segments_are_checked(spark):
    df = spark.range(5).select(F.col("id").alias("pos"))
    for lengths in ([2, 2], [3, 3], [6, -1], []):
        with pytest.raises(ValueError):
            joins.segments(df, "pos", lengths)
    with pytest.raises(ValueError):
        joins.segments(df.select((F.col("pos") + 1).alias("pos")), "pos", [5])
    with pytest.raises(ValueError):
        joins.periodic_segments(df, "pos", [2, 0])
    assert joins.segments(df.where("false"), "pos", []).count() == 0


def test_periodic_segments_equal_listed_ones(spark):
    df = spark.range(57).select(F.col("id").alias("pos"))
    listed = joins.segments(df, "pos", joins.repeated_lengths(57, [4, 1, 6])).select("pos", "segment")
    assert sorted(map(tuple, joins.periodic_segments(df, "pos", [4, 1, 6]).collect())) == sorted(map(tuple, listed.collect()))


def test_functions_see_segments_in_order(spark):
    df = spark.range(12).select(F.col("id").alias("pos")).repartition(5)

    def seen(rows):
        import pandas as pd

        return pd.DataFrame({"s": [int(rows["segment"].iloc[0])], "p": [",".join(map(str, rows["pos"]))]})

    got = joins.apply_segments(joins.segments(df, "pos", [5, 7], reverse=True), seen, "s int, p string").collect()
    assert {r["s"]: r["p"] for r in got} == {0: "4,3,2,1,0", 1: "11,10,9,8,7,6,5"}


def correlations(x, lags):
    out = {}
    for k in range(1, lags + 1):
        a, b = x[:-k], x[k:]
        ok = ~np.isnan(a) & ~np.isnan(b)
        a, b = a[ok], b[ok]
        out[k] = np.corrcoef(a, b)[0, 1] if len(a) > 1 and a.std() > 0 and b.std() > 0 else None
    return out


def check(got, want):
    got = {r["lag"]: r["corr"] for r in got.collect()}
    assert sorted(got) == sorted(want)
    for k, v in want.items():
        assert (got[k] is None) == (v is None), k
        assert v is None or got[k] == pytest.approx(v, abs=1e-9)


@pytest.mark.parametrize("cells", [1, 8, 1 << 18])
@pytest.mark.parametrize("n", [2, 3, 4, 9, 130])
def test_autocorrelation(spark, n, cells):
    r = np.random.default_rng(n)
    x = r.normal(size=n).cumsum() + 1e6
    if n > 9:
        x[[3, 17, 18, n - 1]] = np.nan
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x) if i != 17], "p long, x double").repartition(3)
    check(spectral.autocorrelation(df, "p", "x", task_cells=cells), correlations(x, n // 2))
    check(spectral.autocorrelation(df, "p", "x", n - 1, task_cells=cells), correlations(x, n - 1))


def test_autocorrelation_of_2000_values(spark):
    x = np.random.default_rng(2).exponential(size=2000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "p long, x double")
    check(spectral.autocorrelation(df, "p", "x"), correlations(x, 1000))
    check(spectral.autocorrelation(df, "p", "x", task_cells=256), correlations(x, 1000))


def test_autocorrelation_without_variance(spark):
    df = spark.createDataFrame([(i, 3.0) for i in range(10)], "p long, x double")
    assert [r["corr"] for r in spectral.autocorrelation(df, "p", "x").collect()] == [None] * 5
    missing = spark.createDataFrame([(i, None) for i in range(4)], "p long, x double")
    assert [r["corr"] for r in spectral.autocorrelation(missing, "p", "x").orderBy("lag").collect()] == [None] * 2
    assert spectral.autocorrelation(df.where("false"), "p", "x").count() == spectral.autocorrelation(df.limit(1), "p", "x").count() == 0


def test_what_autocorrelation_writes_is_linear(spark):
    """Bytes between the passes: three complex numbers a cell of the padded series, in each of two shuffles."""
    for n in (1000, 4000):
        x = spark.range(n).select(F.col("id").alias("p"), F.rand(1).alias("x"))
        got = spectral.autocorrelation(x, "p", "x", task_cells=512)
        assert got.count() == n // 2
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3 and "Generate" not in plan and "Join" not in plan


def test_rows_are_counted_where_files_are_small(spark, tmp_path):
    """Compressed files of few bytes hold rows that one task should not sort; any name is good for their place."""
    from paneloom.operators.relational import ordinal

    n = 4_000_000
    spark.range(n, numPartitions=4).select((F.col("id") * 7 % n).alias("k"), F.lit(1.0).alias("a"), F.lit("x").alias("s")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert ranking.estimated_bytes(df.select("k", "a")) < ranking.ONE_WINDOW_BYTES < n * 24
    for name in ("_at", "pos"):
        got = ordinal(df.select("k", "a"), [F.col("k")], name)
        assert "Window" not in got._jdf.queryExecution().toString()
        assert got.columns == ["k", "a", name]
        assert got.where(F.col("k") != F.col(name)).count() == 0 and got.count() == n
    assert "Window" in ordinal(df.limit(1000).select("k", "a"), [F.col("k")], "_at")._jdf.queryExecution().toString()


def test_intervals_over_one_slot_are_shared_by_tasks(spark):
    """1,000 intervals over 4,000 others, all in one slot of starts, are no task's own; nor is a pair lost or doubled."""
    a = spark.range(1000).select(F.col("id").alias("idx"), (-1.0 - F.col("id")).alias("lo"), F.lit(1e9).alias("hi"))
    b = spark.range(4000).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("lo"), (F.col("id") + 0.5).alias("hi"))
    for options in ({}, {"part_pairs": 1 << 16}):
        got = joins.intersect_intervals(a, b, **options)
        shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(shares) == 4_000_000 == got.select("i", "j").distinct().count()
    assert max(shares) < 2_000_000


def test_what_intervals_shuffle_grows_with_the_lists(spark, monkeypatch):
    """Pieces of intervals and copies of slots are no more rows than the lists have, though pairs grow with their product."""
    for rows in (1_000, 1_000_000, 60_000_000, 300_000_000):
        for pairs in (0, rows, rows * rows // 8_000, rows * rows // 4):
            slot, part = joins._slots_and_parts(rows, pairs)
            assert pairs <= rows * slot and pairs * slot <= rows * part
            assert (slot, part) == (4096, 1 << 20) or pairs > 256 * rows
    assert joins._slots_and_parts(0, 0) == (4096, 1 << 20)
    monkeypatch.setattr(joins, "_SLOT", 4)
    monkeypatch.setattr(joins, "_PART_PAIRS", 16)
    written, materialize = {}, joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)))
    a = spark.range(100).select(F.col("id").alias("idx"), (-1.0 - F.col("id")).alias("lo"), F.lit(1e9).alias("hi"))
    b = spark.range(300).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("lo"), (F.col("id") + 0.5).alias("hi"))
    got = joins.intersect_intervals(a, b)
    assert got.count() == 30_000 == got.select("i", "j").distinct().count()
    loads = written["loads"].agg(F.count(F.lit(1)).alias("slots"), F.sum("_parts").alias("parts")).first()
    assert loads["slots"] * 100 <= 400 and loads["parts"] * 128 <= 2 * 400
