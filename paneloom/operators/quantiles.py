"""Interpolated weighted quantiles: values in order with cumulative weights c; a quantile q lies where c reaches
q * total + (total / n) / 2, interpolated by weight between the two values around; below the first it is the first value,
beyond the last the last. With equal weights this is Hazen's definition. One running sum serves all quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.missing import known, valid
from paneloom.plans.ranking import running
from paneloom.plans.shared import materialize

PERCENTILES = (0.99, 0.95, 0.9, 0.75, 0.5, 0.25, 0.1, 0.05, 0.01)


def percentile_name(q: float) -> str:
    return "median" if q == 0.5 else f"p{q * 100:02.0f}"


def _quantiles(base: DataFrame, by: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """base: by, _x, _w (valid). Equal values are one step of their summed weight, as interpolation between them is flat."""
    steps = base.groupBy(*by, "_x").agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n"), F.min("_w").alias("_w1"))
    return _of_steps(steps, by, quantiles)


def _of_steps(steps: DataFrame, by: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """steps: by, _x (once each), _w, _n rows, _w1 weight of its first row. Once cumulative weights are known a quantile is
    four extremes of the steps before and after it, so a group needs no order and no task of its own."""
    cum = running(steps, by, [F.col("_x")], {"_c": F.col("_w")})
    totals = steps.groupBy(*by).agg(F.sum("_w").alias("_tw"), F.sum("_n").alias("_tn"))
    joined = _on(cum, totals, by)
    out = []
    for i, q in enumerate(quantiles):
        t = F.lit(float(q)) * F.col("_tw") + F.col("_tw") / F.col("_tn") / 2
        up, down = F.when(F.col("_c") >= t, F.col("_x")), F.when(F.col("_c") < t, F.col("_x"))
        out += [F.min(up).alias(f"_x{i}"), F.min_by("_w1", up).alias(f"_w{i}"), F.max(down).alias(f"_p{i}"), F.max(F.when(F.col("_c") < t, F.col("_c"))).alias(f"_c{i}")]
    got = joined.groupBy(*by).agg(F.first("_tn").alias("_tn"), F.first("_tw").alias("_tw"), F.max("_x").alias("_top"), *out)
    columns = []
    for i, q in enumerate(quantiles):
        # the span of a value's own rows is flat; from the value before it rises over this value's first row
        t = F.lit(float(q)) * F.col("_tw") + F.col("_tw") / F.col("_tn") / 2
        x, before = F.col(f"_x{i}"), F.col(f"_p{i}")
        rise = (t - F.col(f"_c{i}")) / F.col(f"_w{i}")
        columns.append(F.coalesce(F.when(before.isNull() | (rise >= 1), x).otherwise(before + (x - before) * rise), F.col("_top")).alias(percentile_name(q)))
    return got.select(*by, "_tn", *columns)


def quantiles_of_counts(counts: DataFrame, value: str, n: str, by: Sequence[str] = (), quantiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Interpolated quantiles of values that each occur n times: what an exact incremental state gives."""
    steps = counts.select(*by, known(value).alias("_x"), F.col(n).cast("double").alias("_w"), F.col(n).alias("_n"), F.lit(1.0).alias("_w1"))
    return _of_steps(steps, by, quantiles).drop("_tn")


def _on(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({b: f"_k{i}" for i, b in enumerate(by)})
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return left.join(renamed, same).drop(*[f"_k{i}" for i in range(len(by))])


def weighted_quantiles(df: DataFrame, value: str | Column, weight: str | Column | None = None, *, by: Sequence[str] = (), quantiles: Sequence[float] = PERCENTILES, mad: bool = False, order: Sequence[Column] = ()) -> DataFrame:
    """Groups with their quantiles, and the weighted median of |x - median|. With one valid row only the median is known."""
    base = df.where(valid(value, weight)).select(*by, known(value).alias("_x"), (F.lit(1.0) if weight is None else known(weight)).alias("_w"))
    wanted = list(dict.fromkeys([*quantiles, *([0.5] if mad else [])]))
    got = _quantiles(base, by, wanted)
    lone = F.col("_tn") == 1
    out = got.select(*by, "_tn", *[(F.col(percentile_name(q)) if q == 0.5 else F.when(~lone, F.col(percentile_name(q)))).alias(percentile_name(q)) for q in wanted])
    if mad:
        out = materialize(out, "medians")  # a row for each group, needed twice: the sort behind it is not to run again
        centred = _on(base, out.select(*by, F.col("median").alias("_md")), by).select(*by, F.abs(F.col("_x") - F.col("_md")).alias("_x"), "_w")
        spread = _quantiles(centred, by, [0.5]).select(*by, F.when(~lone, F.col("median")).alias("mad"))
        out = _on(out, spread, by)
    return out.drop("_tn")


def step_percentile(df: DataFrame, value: str | Column, weight: str | Column | None, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Without interpolation: the first value at which the cumulative share of weight reaches q."""
    base = df.where(valid(value, weight)).select(*by, known(value).alias("_x"), (F.lit(1.0) if weight is None else known(weight)).alias("_w"))
    steps = base.groupBy(*by, "_x").agg(F.sum("_w").alias("_w"))
    cum = _on(running(steps, by, [F.col("_x")], {"_c": F.col("_w")}), base.groupBy(*by).agg(F.sum("_w").alias("_tw")), by)
    return cum.groupBy(*by).agg(*[F.min(F.when(F.col("_c") / F.col("_tw") >= F.lit(float(q)) - 1e-12, F.col("_x"))).alias(percentile_name(q)) for q in quantiles])
