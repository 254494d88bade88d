"""Ranks, rolling windows of rows, local smoothers, islands and interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneloom.functions.missing import known, valid
from paneloom.plans.ranking import running

from .relational import ordinal
from .spectral import autocorrelation as autocorrelation


def argsort(df: DataFrame, value: str, pos: str, *, reverse: bool = False) -> DataFrame:
    """Positions in order of the value (ties by position), without missing values: place, pos."""
    v = known(value)
    rows = df.where(v.isNotNull()).select(pos, v.alias("_v"))
    return ordinal(rows, [F.col("_v").desc() if reverse else F.col("_v").asc(), F.col(pos)], "place").select("place", pos)


def rank(df: DataFrame, value: str, pos: str, *, by: Sequence[str] = (), reverse: bool = False, name: str = "rank") -> DataFrame:
    """0-based rank, ties by position; -1 where missing."""
    v = known(value)
    one = running(df.withColumn("_v", v), by, [F.col("_v").desc_nulls_last() if reverse else F.col("_v").asc_nulls_last(), F.col(pos)], {"_n": F.lit(1)})
    return one.withColumn(name, F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(F.col("_n") - 1).cast("long")).drop("_v", "_n")


def percentile_rank(df: DataFrame, value: str, pos: str, weight: str | None = None, *, by: Sequence[str] = (), reverse: bool = False, name: str = "percentile_rank") -> DataFrame:
    """Running weight over total weight; missing where the value or weight is."""
    ok = valid(value, weight)
    w = F.when(ok, known(weight) if weight else F.lit(1.0)).otherwise(F.lit(0.0))
    rows = df.withColumns({"_v": F.when(ok, known(value)), "_w": w})
    cum = running(rows, by, [F.col("_v").desc_nulls_last() if reverse else F.col("_v").asc_nulls_last(), F.col(pos)], {"_c": F.col("_w")})
    total = rows.groupBy(*by).agg(F.sum("_w").alias("_t"))
    if by:
        total = total.withColumnsRenamed({b: f"_k{i}" for i, b in enumerate(by)})
        same = F.lit(True)
        for i, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
        cum = cum.join(total, same).drop(*[f"_k{i}" for i in range(len(by))])
    else:
        cum = cum.crossJoin(F.broadcast(total))
    return cum.withColumn(name, F.when(F.col("_v").isNotNull(), F.col("_c") / F.col("_t"))).drop("_v", "_w", "_c", "_t")


def in_windows(df: DataFrame, pos: str, n: int | Column, size: int, offset: int = 1, name: str = "window") -> DataFrame:
    """Each row once for each full window of `size` rows (starting every `offset`) that it lies in. `n`: rows in all."""
    if size < 1:
        raise ValueError("size must be at least 1")
    p = F.col(pos)
    first = F.ceil(F.greatest(p - size + 1, F.lit(0)) / offset)
    total = F.lit(n) if isinstance(n, int) else n
    last = F.least(F.floor(p / offset), F.floor((total - size) / offset))
    return df.withColumns({"_lo": first.cast("long"), "_hi": last.cast("long")}).where("_lo <= _hi").withColumn(name, F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def size_offset(n: int, size: float, overlap: float = 1.0, fit_edges: bool = False) -> tuple[int, int]:
    """Rows of a window, and from one start to the next. A size of at most 1 is a share of the n rows; `overlap` windows
    cover a row; with `fit_edges` a window takes in the rows that would remain after the last one."""
    rows = max(int(size) if size > 1 else round(size * n), 0)
    every = max(1, round(rows / overlap))
    return rows + (n - rows) % every * (fit_edges and rows < n), every


def rolling_stats(df: DataFrame, pos: str, aggregates: Sequence[Column], *, size: float, overlap: float = 1.0, offset: int | None = None, fit_edges: bool = False, n: int | None = None) -> DataFrame:
    """Statistics of each full window of consecutive rows."""
    n = df.count() if n is None else n
    size, step = size_offset(n, size, overlap, fit_edges)
    return in_windows(df, pos, n, size, offset or step).groupBy("window").agg(*aggregates)


def nearest_stats(df: DataFrame, x: str, tie: str, aggregates: Sequence[Column], *, size: float, overlap: float = 1.0, fit_edges: bool = False) -> DataFrame:
    """Rolling statistics over rows in order of x (rows without x dropped): a local smoother."""
    rows = df.where(known(x).isNotNull())
    return rolling_stats(ordinal(rows, [known(x), F.col(tie)], "_at"), "_at", aggregates, size=size, overlap=overlap, fit_edges=fit_edges)


def islands(df: DataFrame, pos: str, masked: Column) -> DataFrame:
    """Runs of consecutive positions that are not masked, each reaching one point to the left: start, stop (inclusive)."""
    open_rows = df.where(~F.coalesce(masked, F.lit(False))).select(pos)
    placed = ordinal(open_rows, [F.col(pos)], "_n")
    return placed.groupBy((F.col(pos) - F.col("_n")).alias("_g")).agg(F.greatest(F.min(pos) - 1, F.lit(0)).alias("start"), F.max(pos).alias("stop")).drop("_g")


def interpolate(df: DataFrame, pos: str, value: str, wanted: DataFrame, at: str) -> DataFrame:
    """Linear interpolation at fractional positions: `wanted` and `value`."""
    a = df.select(F.col(pos).cast("long").alias("_lo"), F.col(value).alias("_a"))
    b = df.select(F.col(pos).cast("long").alias("_hi"), F.col(value).alias("_b"))
    rows = wanted.withColumns({"_lo": F.floor(at).cast("long"), "_hi": F.ceil(at).cast("long")}).join(a, "_lo").join(b, "_hi")
    return rows.withColumn(value, F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col(at) - F.col("_lo"))).drop("_lo", "_hi", "_a", "_b")


def stretch(df: DataFrame, pos: str, value: str, to_length: int) -> DataFrame:
    """A column resampled linearly to another length: place, value."""
    n = df.count()
    scale = (n - 1) / (to_length - 1) if to_length > 1 else 0.0
    places = df.sparkSession.range(to_length).select(F.col("id").alias("place"), F.least(F.col("id") * F.lit(scale), F.lit(float(n - 1))).alias("_at"))
    return interpolate(df, pos, value, places, "_at").select("place", value)
