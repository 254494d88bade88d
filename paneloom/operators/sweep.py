"""Many least squares fits from one matrix of moments and one look at the residuals.

Sums of products of all variables that any fit needs come from one aggregate, around each group's own means, so they do
not cancel however far the values are from 0. A fit is then a sweep of that matrix on its predictors, and fits that begin
with the same predictors share those sweeps. The residuals of all fits are sums of one second aggregate.

Sums of several batches (updates, micro-batches of a stream) around different means are moved to a common one and added: they
are the state of a regression that grows. What residuals are taken of is told apart from it: rows given, else all updates,
else the last one, else none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.missing import known
from paneloom.plans.shared import checked_broadcast, materialize

from .multivariate import moment_sums


@dataclass(frozen=True)
class Fit:
    """A response on predictors, with a name for the result."""

    label: str
    response: str
    predictors: tuple[str, ...]


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on all of `by`, NULL keys included; `right` has a row for each group."""
    small = checked_broadcast(right.withColumnsRenamed({b: f"_key{i}" for i, b in enumerate(by)}))
    same = reduce(lambda a, i: a & F.col(by[i]).eqNullSafe(F.col(f"_key{i}")), range(len(by)), F.lit(True))
    return left.join(small, same, how).drop(*[f"_key{i}" for i in range(len(by))])


def shifted_sums(df: DataFrame, variables: Sequence[str], weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, the sums of `moment_sums`, and h<i>, the means around which group by group they are taken."""
    values = [known(v) for v in variables]
    rows = df.select(*by, *[v.alias(f"_v{i}") for i, v in enumerate(values)], (F.lit(1.0) if weight is None else known(weight).cast("double")).alias("_w"))
    # an infinite value must stay in the sums, where it leaves a group without coefficients: less an infinite mean it is missing
    finite = [F.when(F.abs(F.avg(f"_v{i}")) < float("inf"), F.avg(f"_v{i}")) for i in range(len(values))]
    means = materialize(rows.groupBy(*by).agg(*[F.coalesce(m, F.lit(0.0)).alias(f"h{i}") for i, m in enumerate(finite)]), "means")
    k = range(len(values))
    moved = _beside(rows, means, by).withColumns({f"_v{i}": F.col(f"_v{i}") - F.col(f"h{i}") for i in k})
    return moved.groupBy(*by).agg(*moment_sums([f"_v{i}" for i in k], "_w"), *[F.max(f"h{i}").alias(f"h{i}") for i in k])


def added(sums: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Several rows of `shifted_sums` for a group made one: moved to the means of its largest part and summed."""
    sums = materialize(sums, "sums")
    common = sums.groupBy(*by).agg(F.max_by(F.struct(*[f"h{i}" for i in range(k)]), "size").alias("_to"))
    rows = _beside(sums, materialize(common, "common"), by)
    d = [F.col(f"h{i}") - F.col(f"_to.h{i}") for i in range(k)]
    out = [F.sum("n").alias("n"), F.sum("size").alias("size"), *[F.first(f"_to.h{i}").alias(f"h{i}") for i in range(k)]]
    for i in range(k):
        out.append(F.sum(F.col(f"s{i}") + d[i] * F.col(f"u{i}_{i}")).alias(f"s{i}"))
        for j in range(i, k):
            u, p = F.col(f"u{i}_{j}"), F.col(f"p{i}_{j}")
            a, b = (F.col(f"s{i}"), F.col(f"s{i}")) if i == j else (F.col(f"a{i}_{j}"), F.col(f"b{i}_{j}"))
            out.append(F.sum(p + d[i] * b + d[j] * a + d[i] * d[j] * u).alias(f"p{i}_{j}"))
            out += [F.sum(f"{c}{i}_{j}").alias(f"{c}{i}_{j}") for c in "ucv"]
            if i < j:
                out += [F.sum(a + d[i] * u).alias(f"a{i}_{j}"), F.sum(b + d[j] * u).alias(f"b{i}_{j}")]
    return rows.groupBy(*by).agg(*out)


def swept(m: np.ndarray, k: int) -> np.ndarray | None:
    """The matrix swept on one variable: what regressing all others on it gives. None where it has no variance left."""
    pivot = m[k, k]
    if not np.isfinite(pivot) or pivot == 0:
        return None
    out = m - np.outer(m[:, k], m[k]) / pivot
    out[k], out[:, k] = m[k] / pivot, m[:, k] / pivot
    out[k, k] = -1.0 / pivot
    return out


def _solver(fits: Sequence[tuple[int, tuple[int, ...]]], k: int, constant: bool) -> Callable:
    def of_row(r: dict) -> tuple[list, list]:
        def get(name: str, i: int, j: int) -> float:
            v = r[f"{name}{min(i, j)}_{max(i, j)}"]
            return np.nan if v is None else v

        h = np.array([r[f"h{i}"] for i in range(k)], float)
        mean = np.array([np.nan if not r[f"u{i}_{i}"] else r[f"s{i}"] / r[f"u{i}_{i}"] for i in range(k)], float)
        m = np.empty((k, k))
        for i in range(k):
            for j in range(k):
                lo, hi = min(i, j), max(i, j)
                u = get("u", lo, hi) or np.nan
                a, b = (mean[i], mean[i]) if i == j else (get("a", lo, hi) / u, get("b", lo, hi) / u)
                p = get("p", lo, hi) / u
                if constant:  # around each variable's own mean, as sweeping on the constant leaves it
                    m[i, j] = p - mean[lo] * mean[hi] + h[lo] * (b - mean[hi]) + h[hi] * (a - mean[lo])
                else:
                    m[i, j] = p + h[lo] * b + h[hi] * a + h[lo] * h[hi]
        mu = mean + h
        done: dict[tuple[int, ...], np.ndarray | None] = {(): m}

        def on(predictors: tuple[int, ...]) -> np.ndarray | None:
            if predictors not in done:
                before = on(predictors[:-1])
                done[predictors] = None if before is None else swept(before, predictors[-1])
            return done[predictors]

        betas, inverses = [], []
        for y, predictors in fits:
            x = list(predictors)
            got = on(predictors) if r["n"] > 1 and np.isfinite(m[np.ix_([*x, y], [*x, y])]).all() else None
            if got is None or not np.isfinite(got[np.ix_(x, [*x, y])]).all():
                betas.append(None)
                inverses.append(None)
                continue
            beta, inverse = got[x, y], -got[np.ix_(x, x)]
            if constant:
                side = -inverse @ mu[x]
                beta = np.r_[mu[y] - beta @ mu[x], beta]
                inverse = np.block([[np.array([[1 - side @ mu[x]]]), side[None, :]], [side[:, None], inverse]])
            betas.append(beta.tolist())
            inverses.append(inverse.ravel().tolist())
        return betas, inverses

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [of_row(r) for r in f.to_dict("records")]
            yield f.assign(betas=[b for b, _ in got], inverses=[i for _, i in got])

    return solve


def _variables(fits: Sequence[Fit]) -> list[str]:
    return list(dict.fromkeys(v for f in fits for v in (*f.predictors, f.response)))


def solved(sums: DataFrame, fits: Sequence[Fit], by: Sequence[str] = (), *, constant: bool = True) -> DataFrame:
    """The sums of all the fits' variables, in order of their first use, with betas and inverses: an array for each fit."""
    place = {v: i for i, v in enumerate(_variables(fits))}
    wanted = [(place[f.response], tuple(place[p] for p in f.predictors)) for f in fits]
    schema = ", ".join(f"`{n}` {t}" for n, t in sums.dtypes) + ", betas array<array<double>>, inverses array<array<double>>"
    return materialize(sums.mapInPandas(_solver(wanted, len(place), constant), schema), "solved")


def _predicted(f: int, fit: Fit, constant: bool) -> Column:
    beta = F.col("_betas")[f]
    total = beta[0] if constant else F.lit(0.0)
    for i, p in enumerate(fit.predictors):
        total = total + F.coalesce(known(p), F.lit(0.0)) * beta[i + constant]
    return total


def statistics(solution: DataFrame, fits: Sequence[Fit], rows: DataFrame | None, weight: str | None = None, by: Sequence[str] = (), *, constant: bool = True, redundancy: float = 1.0) -> DataFrame:
    """by, label, size, count, d_count, mean_wt, R2, residual_squares, residual, names, coefficients, sigma, t_stat, inverse: a row
    for each group and fit. Residual statistics are of `rows`; without any they are NULL."""
    place = {v: i for i, v in enumerate(_variables(fits))}
    if rows is not None:
        w = F.lit(1.0) if weight is None else F.when(known(weight) > 0, known(weight))
        held = _beside(rows, solution.select(*by, F.col("betas").alias("_betas")), by)
        sums = []
        for f, fit in enumerate(fits):
            y = known(fit.response)
            some = F.lit(True) if constant else F.coalesce(*[known(p) for p in fit.predictors]).isNotNull()
            e = y - _predicted(f, fit, constant)
            u = F.when(e.isNotNull() & some, w)
            sums += [(F.sum(u * e * e) / F.sum(u)).alias(f"_rs{f}"), (F.sum(u * y * y) / F.sum(u)).alias(f"_ms{f}")]
        second = materialize(held.groupBy(*by).agg(*sums), "residuals")
        solution = _beside(solution, second, by, "left")
    cells = []
    for f, fit in enumerate(fits):
        y, x = place[fit.response], [place[p] for p in fit.predictors]

        def d_count(i: int) -> Column:
            return F.try_divide(F.col(f"u{i}_{i}") * F.col(f"u{i}_{i}"), F.col(f"v{i}_{i}"))

        squares = F.col(f"_rs{f}") if rows is not None else F.lit(None).cast("double")
        own = F.col(f"s{y}") / F.col(f"u{y}_{y}")
        base = F.col(f"p{y}_{y}") / F.col(f"u{y}_{y}") - own * own if constant else (F.col(f"_ms{f}") if rows is not None else F.lit(None).cast("double"))
        beta, inverse = F.col("betas")[f], F.col("inverses")[f]
        names = [*(["constant"] if constant else []), *fit.predictors]
        cov = [inverse[i * len(names) + i] * squares for i in range(len(names))]
        dn = [*([d_count(y)] if constant else []), *[d_count(i) for i in x]]
        sigma = [F.when(c > 0, F.sqrt(c)) for c in cov]
        t = [F.when(c > 0, beta[i] * F.sqrt(F.try_divide(dn[i], c) / redundancy)) for i, c in enumerate(cov)]
        cells.append(F.struct(F.lit(fit.label).alias("label"), d_count(y).alias("d_count"), (F.col(f"u{y}_{y}") / F.col(f"c{y}_{y}")).alias("mean_wt"), (1 - F.try_divide(squares, base)).alias("R2"), squares.alias("residual_squares"), F.sqrt(squares).alias("residual"), F.array(*map(F.lit, names)).alias("names"), beta.alias("coefficients"), F.array(*sigma).alias("sigma"), F.array(*t).alias("t_stat"), inverse.alias("inverse")))
    return solution.select(*by, "size", F.col("n").alias("count"), F.explode(F.array(*cells)).alias("_c")).select(*by, "size", "count", "_c.*")


def sweep(df: DataFrame, fits: Sequence[Fit], weight: str | None = None, *, constant: bool = True, by: Sequence[str] = (), redundancy: float = 1.0) -> DataFrame:
    """`statistics` of all fits over all rows: one aggregate of moments and one of residuals, however many fits there are."""
    solution = solved(shifted_sums(df, _variables(fits), weight, by), fits, by, constant=constant)
    return statistics(solution, fits, df, weight, by, constant=constant, redundancy=redundancy)


def in_columns(long: DataFrame, fits: Sequence[Fit], label: str, by: Sequence[str] = (), *, constant: bool = True) -> DataFrame:
    """A column for each coefficient, with its t-statistic (T) and sigma (S); NULL where a fit does not have it."""
    names = list(dict.fromkeys([*(["constant"] if constant else []), *(p for f in fits for p in f.predictors)]))
    columns = [*by, F.col("label").alias(label), "size", "count", "d_count", "mean_wt", "R2", "residual_squares", "residual"]
    for n in names:
        at = F.array_position("names", n).cast("int")
        columns += [F.when(at > 0, F.get(c, at - 1)).alias(n + suffix) for c, suffix in (("coefficients", ""), ("t_stat", "T"), ("sigma", "S"))]
    return long.select(*columns)


@dataclass
class RegressionTable:
    """A regression that grows by updates. Each update leaves its sums, a row for each group, in the shared folder; its rows are
    remembered (as a table, not copied) if `store_last` or `store_all` says so."""

    fits: Sequence[Fit]
    weight: str | None = None
    by: Sequence[str] = ()
    constant: bool = True
    store_last: bool = False
    store_all: bool = False
    sums: DataFrame | None = None
    kept: list[DataFrame] = field(default_factory=list)

    def update(self, df: DataFrame) -> RegressionTable:
        new = shifted_sums(df, _variables(self.fits), self.weight, self.by)
        old = self.sums
        self.sums = materialize(new if old is None else added(old.unionByName(new), len(_variables(self.fits)), self.by), "state")
        if self.store_last or self.store_all:
            self.kept = [*(self.kept if self.store_all else []), df]
        return self

    def residual_rows(self, given: DataFrame | None = None, use_last: bool | None = None, use_all: bool | None = None) -> DataFrame | None:
        """Rows given; else those of all updates, if they are stored and not refused; else of the last one; else none."""
        if given is not None:
            return given
        if self.store_all and self.kept and use_all is not False:
            return reduce(lambda a, b: a.unionByName(b), self.kept)
        if (self.store_last or self.store_all) and self.kept and use_last is not False:
            return self.kept[-1]
        return None

    def compute(self, given: DataFrame | None = None, *, use_last: bool | None = None, use_all: bool | None = None, redundancy: float = 1.0) -> DataFrame:
        if self.sums is None:
            raise ValueError("no update yet")
        solution = solved(self.sums, self.fits, self.by, constant=self.constant)
        rows = self.residual_rows(given, use_last, use_all)
        return statistics(solution, self.fits, rows, self.weight, self.by, constant=self.constant, redundancy=redundancy)

    def predict(self, rows: DataFrame, *, forecast: str | None = "forecast", errors: str | None = "error", residual_rows: DataFrame | None = None) -> DataFrame:
        """Rows with the first fit's forecast and its error sqrt(x' C x); a missing predictor adds nothing to either."""
        fit = self.fits[0]
        got = materialize(self.compute(residual_rows).where(F.col("label") == fit.label).select(*self.by, F.array("coefficients").alias("_betas"), F.col("inverse").alias("_inverse"), F.col("residual_squares").alias("_rs")), "fit")
        out = _beside(rows, got, self.by, "left")
        if forecast:
            out = out.withColumn(forecast, _predicted(0, fit, self.constant))
        if errors:
            x = [*([F.lit(1.0)] if self.constant else []), *[F.coalesce(known(p), F.lit(0.0)) for p in fit.predictors]]
            total = reduce(lambda a, b: a + b, [x[i] * x[j] * F.col("_inverse")[i * len(x) + j] for i in range(len(x)) for j in range(len(x))])
            out = out.withColumn(errors, F.sqrt(total * F.col("_rs")))
        return out.drop("_betas", "_inverse", "_rs")
