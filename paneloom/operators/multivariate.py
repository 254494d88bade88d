"""Pairwise-complete cross moments of several variables, from one aggregate of k(k+1)/2 conditional sums.

`moment_sums` gives one row for each group with additive sums only, so batches and streams combine; sums are taken around
a fixed shift for each variable, which keeps covariances from cancelling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.missing import known


def moment_sums(variables: Sequence[str | Column], weight: str | Column | None = None, shifts: Sequence[float] | None = None) -> list[Column]:
    """Aggregates n, s<i>, w<i>, q<i> and for i <= j: p<i>_<j>, u<i>_<j>, c<i>_<j>, v<i>_<j>.

    Of variable i over rows where it is known: w weight, s weighted sum, q squared weights, c<i>_<i> count. Of a pair over
    rows where both are: u weight, p weighted product, c count, v squared weights. Rows of weight <= 0 count nowhere.
    """
    w = F.lit(1.0) if weight is None else F.when(known(weight) > 0, known(weight))
    shifts = shifts or [0.0] * len(variables)
    x = [F.when(w.isNotNull(), known(v) - F.lit(float(s))) for v, s in zip(variables, shifts)]
    out = [F.count(F.when(F.coalesce(*x).isNotNull(), F.lit(1))).alias("n"), F.count(F.lit(1)).alias("size")]
    for i, a in enumerate(x):
        out.append(F.sum(w * a).alias(f"s{i}"))
        for j in range(i, len(x)):
            both = F.when(a.isNotNull() & x[j].isNotNull(), w)
            out += [F.sum(both * a * x[j]).alias(f"p{i}_{j}"), F.sum(both).alias(f"u{i}_{j}"), F.count(both).alias(f"c{i}_{j}"), F.sum(both * both).alias(f"v{i}_{j}")]
            if j > i:
                out += [F.sum(both * a).alias(f"a{i}_{j}"), F.sum(both * x[j]).alias(f"b{i}_{j}")]
    return out


def moment_matrix(sums: DataFrame, names: Sequence[str], by: Sequence[str] = (), shifts: Sequence[float | Column] | None = None) -> DataFrame:
    """Long form: by, i, j, count, mean_wt, d_count, mean, sum, variance, std_dev, correlation, multiple for every i, j.

    Covariance and correlation take each variable's own mean and variance (not the pair's), as they are defined here.
    """
    k = len(names)
    sh = [s if isinstance(s, Column) else float(s) for s in (shifts or [0.0] * k)]
    mean = [F.col(f"s{i}") / F.col(f"u{i}_{i}") for i in range(k)]  # shifted
    square = [F.col(f"p{i}_{i}") / F.col(f"u{i}_{i}") for i in range(k)]
    var = [square[i] - mean[i] * mean[i] for i in range(k)]
    cells = []
    for i in range(k):
        for j in range(k):
            lo, hi = min(i, j), max(i, j)
            u = F.col(f"u{lo}_{hi}")
            product = F.col(f"p{lo}_{hi}") / u
            if lo == hi:
                a = b = mean[i]
            else:
                a, b = F.col(f"a{lo}_{hi}") / u, F.col(f"b{lo}_{hi}") / u
            raw = product + F.lit(sh[lo]) * b + F.lit(sh[hi]) * a + F.lit(sh[lo] * sh[hi])  # E[x_lo x_hi] unshifted
            # raw - mu_lo mu_hi with marginal means, all shifts taken out before the difference
            cov = product - mean[lo] * mean[hi] + F.lit(sh[lo]) * (b - mean[hi]) + F.lit(sh[hi]) * (a - mean[lo])
            raw_jj = square[j] + 2 * F.lit(sh[j]) * mean[j] + F.lit(sh[j] ** 2)
            cells.append(
                F.struct(
                    F.lit(names[i]).alias("i"), F.lit(names[j]).alias("j"), F.col(f"c{lo}_{hi}").alias("count"), (u / F.col(f"c{lo}_{hi}")).alias("mean_wt"), (u * u / F.col(f"v{lo}_{hi}")).alias("d_count"),
                    raw.alias("mean"), (raw * F.col(f"c{lo}_{hi}")).alias("sum"), cov.alias("variance"), (F.sqrt(F.abs(cov)) * F.signum(cov)).alias("std_dev"),
                    F.try_divide(cov, F.sqrt(var[i] * var[j])).alias("correlation"), F.try_divide(raw, raw_jj).alias("multiple"),
                )
            )
    return sums.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")


def multivariate(df: DataFrame, variables: Sequence[str], weight: str | None = None, by: Sequence[str] = (), shifts: Sequence[float] | None = None) -> DataFrame:
    return moment_matrix(df.groupBy(*by).agg(*moment_sums(variables, weight, shifts)), variables, by, shifts)


def as_matrix(long: DataFrame, statistic: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A row for each variable ('factor') with a column for each other."""
    return long.groupBy(*by, F.col("i").alias("factor")).pivot("j", list(names)).agg(F.first(statistic))


def multivariate_steps(df: DataFrame, variables: Sequence[str], pos: str, step: int | Sequence[int], weight: str | None = None, shifts: Sequence[float] | None = None) -> DataFrame:
    """Cross moments of each clump of consecutive rows (see `stats.clump`): clump, i, j and the statistics."""
    from .stats import clump

    return multivariate(df.withColumn("clump", clump(pos, step)), variables, weight, ["clump"], shifts)
