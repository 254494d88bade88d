"""Mathematical column functions. Missing stays missing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .missing import col, known


def dir_clip(x, clip) -> Column:
    """The part of x between 0 and the clip; 0 where their signs differ; x where the clip is missing."""
    v, c = known(x), known(clip) if not isinstance(clip, (int, float)) else F.lit(float(clip))
    return F.when(c.isNull(), v).when(v * c < 0, F.lit(0.0)).otherwise(F.signum(v) * F.least(F.abs(v), F.abs(c)))


def toward_zero(x, value: float) -> Column:
    v = known(x)
    return F.signum(v) * F.greatest(F.abs(v) - F.lit(float(value)), F.lit(0.0))


def per_clip(df: DataFrame, x: str, caps, name: str | None = None) -> DataFrame:
    """Clipped to percentiles (0-100, linear between order statistics); one number caps the top only."""
    v = known(x)
    if isinstance(caps, (int, float)):
        bounds = df.agg(F.percentile(v, float(caps) / 100).alias("_hi"))
        return df.crossJoin(F.broadcast(bounds)).withColumn(name or x, F.when(v.isNotNull(), F.least(v, F.col("_hi")))).drop("_hi")
    lo, hi = caps
    bounds = df.agg(F.percentile(v, float(lo) / 100).alias("_lo"), F.percentile(v, float(hi) / 100).alias("_hi"))
    return df.crossJoin(F.broadcast(bounds)).withColumn(name or x, F.when(v.isNotNull(), F.greatest(F.least(v, F.col("_hi")), F.col("_lo")))).drop("_lo", "_hi")


def scale2unit(df: DataFrame, x: str, *, eps: float = 0.1, soft_clip: float | None = 99.99, name: str | None = None) -> DataFrame:
    """Divided by a percentile (or the maximum) of |x|, times 1 - eps, clipped to [-1, 1]."""
    v = known(x)
    top = F.max(F.abs(v)) if soft_clip is None else F.percentile(F.abs(v), soft_clip / 100)
    scaled = v / F.nullif(F.col("_top"), F.lit(0.0)) * F.lit(1 - eps)
    return df.crossJoin(F.broadcast(df.agg(top.alias("_top")))).withColumn(name or x, F.when(v.isNotNull(), F.greatest(F.least(scaled, F.lit(1.0)), F.lit(-1.0)))).drop("_top")


def softmax(df: DataFrame, x: str, by: Sequence[str] = (), name: str = "softmax") -> DataFrame:
    """exp(x) over its group's sum, shifted by the group's maximum; two aggregates with partial sums and no window."""
    v = known(x)
    top = df.groupBy(*by).agg(F.max(v).alias("_m"))
    rows = _with(df, top, by)
    total = rows.groupBy(*by).agg(F.sum(F.exp(v - F.col("_m"))).alias("_s"))
    return _with(rows, total, by).withColumn(name, F.exp(v - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def _with(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return df.crossJoin(F.broadcast(small))
    small = small.withColumnsRenamed({b: f"_k{i}" for i, b in enumerate(by)})
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return df.join(small, same).drop(*[f"_k{i}" for i in range(len(by))])


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-known(x)))


def logit(x, eps: float = 1e-8) -> Column:
    return -F.ln(1 / (known(x) + eps) - 1 + eps)


def elu(x, alpha: float = 1.0) -> Column:
    v = known(x)
    return F.when(v < 0, alpha * (F.exp(v) - 1)).otherwise(v)


def celu(x, alpha: float = 1.0) -> Column:
    v = known(x)
    return F.when(v < 0, alpha * (F.exp(v / alpha) - 1)).otherwise(v)


def ielu(x, eps: float = 1e-20) -> Column:
    v = known(x)
    return F.when(v < 0, F.ln(v + 1 + eps)).otherwise(v)


def llu(x) -> Column:
    """Linear in [-1, 1], logarithmic outside."""
    v = known(x)
    return F.when(F.abs(v) <= 1, v).otherwise(F.signum(v) * (1 + F.ln(F.greatest(F.abs(v), F.lit(1.0)))))


def illu(x) -> Column:
    v = known(x)
    return F.when(F.abs(v) <= 1, v).otherwise(F.signum(v) * F.exp(F.abs(v) - 1))


def sroot(x, power: float = 0.5) -> Column:
    v = known(x)
    return F.signum(v) * F.pow(F.abs(v), F.lit(power))


def zip_reduce(kind: str, *args) -> Column:
    """Elementwise min, max, sum or mean over columns and numbers; missing in any makes it missing."""
    parts = [F.lit(float(a)) if isinstance(a, (int, float)) else known(a) for a in args]
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    total = sum(parts[1:], parts[0])
    out = {"min": F.least(*parts), "max": F.greatest(*parts), "sum": total, "mean": total / len(parts)}[kind]
    return F.when(whole, out)


def zip_func(func: Callable, *args) -> Column:
    """Any numpy-style reduction over the stacked columns, in Arrow batches."""
    @F.pandas_udf("double")
    def apply(rows: pd.Series) -> pd.Series:
        return pd.Series(func(np.array(rows.tolist(), dtype=float), axis=1)) if len(rows) else pd.Series([], dtype=float)

    return apply(F.array(*[F.lit(float(a)) if isinstance(a, (int, float)) else known(a) for a in args]))


def squarest_factors(n) -> Column:
    """The pair of factors nearest a square, the smaller first."""
    x = col(n).cast("long")
    small = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(F.floor(F.sqrt(x)).cast("long"), F.lit(1).cast("long"))), lambda i: x % i == 0))
    return F.struct(small.alias("a"), (x / small).cast("long").alias("b"))


def reciprocal_weights(d, scale: float = 1.0, power: float = 1.0) -> Column:
    return F.pow(1 / (1 + known(d) * scale), F.lit(power))


def running_share(x: str, by: Sequence[str]) -> Column:
    return known(x) / F.sum(known(x)).over(W.partitionBy(*by))
