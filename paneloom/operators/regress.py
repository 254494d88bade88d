"""Weighted least squares on normal equations from pairwise-complete moments, grouped or not.

One aggregate gives every group's moments; the k-by-k systems are solved in a pandas UDF on the groups' rows (there are as
many as groups), and coefficients go back to the rows for the residuals in a second aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.functions.missing import known
from paneloom.plans.shared import checked_broadcast, materialize

from .multivariate import moment_sums
from .sweep import Fit, RegressionTable, in_columns, sweep


def _solver(k: int, constant: bool):
    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            betas, inverses = [], []
            for r in f.to_dict("records"):
                m = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] / r[f"u{min(i, j)}_{max(i, j)}"] if r[f"u{min(i, j)}_{max(i, j)}"] else np.nan for j in range(k + 1)] for i in range(k + 1)], float)
                xx, xy = m[:k, :k], m[:k, k]
                if constant:
                    mu = np.array([r[f"s{i}"] / r[f"u{i}_{i}"] for i in range(k + 1)], float)
                    xx = np.block([[np.ones((1, 1)), mu[None, :k]], [mu[:k, None], xx]])
                    xy = np.r_[mu[k], xy]
                if r["n"] > 1 and np.isfinite(xx).all():
                    try:
                        inv = np.linalg.inv(xx)
                        betas.append((inv @ xy).tolist())
                        inverses.append(inv.ravel().tolist())
                        continue
                    except np.linalg.LinAlgError:
                        pass
                betas.append(None)
                inverses.append(None)
            yield f.assign(beta=betas, inverse=inverses)

    return solve


def fit(df: DataFrame, response: str, predictors: Sequence[str], weight: str | None = None, *, constant: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """by, size, count, d_count, mean_wt, beta (the constant first), inverse (of the moment matrix), dn (effective counts)."""
    k = len(predictors)
    sums = df.groupBy(*by).agg(*moment_sums([*predictors, response], weight))
    solved = sums.mapInPandas(_solver(k, constant), f"{_ddl(sums)}, beta array<double>, inverse array<double>")
    own = [F.col(f"u{i}_{i}") * F.col(f"u{i}_{i}") / F.col(f"v{i}_{i}") for i in range(k)]
    y = f"{k}_{k}"
    overall = F.col(f"u{y}") * F.col(f"u{y}") / F.col(f"v{y}")
    dn = F.array(*([overall] if constant else []), *own)
    return materialize(solved.select(*by, "size", F.col("n").alias("count"), overall.alias("d_count"), (F.col(f"u{y}") / F.col(f"c{y}")).alias("mean_wt"), "beta", "inverse", dn.alias("dn")), "fit")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def forecast(df: DataFrame, fits: DataFrame, predictors: Sequence[str], *, constant: bool = True, by: Sequence[str] = (), name: str = "predicted", drop_missing: bool = False) -> DataFrame:
    """Predicted values; a missing predictor adds nothing (or, with `drop_missing`, makes the prediction missing)."""
    small = checked_broadcast(fits.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("beta").alias("_beta")))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    joined = df.join(small, same, "left") if by else df.crossJoin(F.broadcast(small))
    at = 1 if constant else 0
    total = F.col("_beta")[0] if constant else F.lit(0.0)
    for i, p in enumerate(predictors):
        x = known(p)
        total = total + (x if drop_missing else F.coalesce(x, F.lit(0.0))) * F.col("_beta")[i + at]
    return joined.withColumn(name, total).drop("_beta", *[f"_k{i}" for i in range(len(by))])


def regress(df: DataFrame, response: str, predictors: Sequence[str], weight: str | None = None, *, constant: bool = True, by: Sequence[str] = (), redundancy: float = 1.0) -> DataFrame:
    """by, size, count, d_count, mean_wt, R2, residual_squares, residual, and for each coefficient value, <name>T, <name>S."""
    fits = fit(df, response, predictors, weight, constant=constant, by=by)
    y = known(response)
    w = F.lit(1.0) if weight is None else F.when(known(weight) > 0, known(weight))
    rows = forecast(df, fits, predictors, constant=constant, by=by).withColumns({"_y": F.when(w.isNotNull(), y), "_w": w})
    any_known = F.coalesce(*[known(p) for p in predictors]).isNotNull() if not constant else F.lit(True)
    u = F.when(F.col("_y").isNotNull() & F.col("predicted").isNotNull() & any_known, F.col("_w"))
    e = F.col("_y") - F.col("predicted")
    centre = F.sum(u * F.col("_y")) / F.sum(u)
    spread = F.sum(u * F.col("_y") * F.col("_y")) / F.sum(u)
    lean = F.covar_pop(u, F.when(u.isNotNull(), F.col("_y"))) / F.avg(u)
    yv = F.when(u.isNotNull(), F.col("_y"))
    variance = (F.covar_pop(u * yv, yv) - F.avg(yv) * F.covar_pop(u, yv)) / F.avg(u) - lean * lean
    del centre
    second = rows.groupBy(*by).agg((F.sum(u * e * e) / F.sum(u)).alias("residual_squares"), (variance if constant else spread).alias("_base"))
    names = [*(["constant"] if constant else []), *predictors]
    m = len(names)
    if by:
        second = second.withColumnsRenamed({b: f"_k{i}" for i, b in enumerate(by)})
        same = F.lit(True)
        for i, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
        out = fits.join(second, same)
    else:
        out = fits.crossJoin(second)
    columns = [*by, "size", "count", "d_count", "mean_wt", (1 - F.try_divide(F.col("residual_squares"), F.col("_base"))).alias("R2"), "residual_squares", F.sqrt("residual_squares").alias("residual")]
    for i, name in enumerate(names):
        cov = F.col("inverse")[i * m + i] * F.col("residual_squares")
        columns += [F.col("beta")[i].alias(name), (F.col("beta")[i] * F.sqrt(F.try_divide(F.col("dn")[i], cov) / redundancy)).alias(f"{name}T"), F.sqrt(cov).alias(f"{name}S")]
    return out.select(*columns)


def errors(df: DataFrame, response: str, predictors: Sequence[str], weight: str | None = None, *, constant: bool = True, by: Sequence[str] = (), name: str = "error") -> DataFrame:
    """`df` with the error of each row's forecast, sqrt(x' C x), C being the inverse of its group's moments times its residual
    variance. A missing predictor adds nothing."""
    fitted = RegressionTable([Fit("fit", response, tuple(predictors))], weight, by, constant).update(df)
    return fitted.predict(df, forecast=None, errors=name, residual_rows=df)


def loop(df: DataFrame, responses: Sequence[str], predictors: Sequence[str], weight: str | None = None, *, constant: bool = True, by: Sequence[str] = (), redundancy: float = 1.0) -> DataFrame:
    """A fit for each response over all predictors, all from one look at the moments and one at the residuals."""
    fits = [Fit(r, r, tuple(predictors)) for r in responses]
    return in_columns(sweep(df, fits, weight, constant=constant, by=by, redundancy=redundancy), fits, "response", by, constant=constant)


def panel(df: DataFrame, response: str, predictors: Sequence[str], weight: str | None = None, *, constant: bool = True, by: Sequence[str] = (), redundancy: float = 1.0) -> DataFrame:
    """Fits on all predictors, then without the last, and so on, from one look at each; absent coefficients are NULL."""
    fits = [Fit(str(k), response, tuple(predictors[:k])) for k in range(len(predictors), 0, -1)]
    out = in_columns(sweep(df, fits, weight, constant=constant, by=by, redundancy=redundancy), fits, "n_predictors", by, constant=constant)
    return out.withColumn("n_predictors", F.col("n_predictors").cast("int"))
