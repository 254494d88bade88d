"""Descriptive statistics, optionally weighted, over groups, splits, overlapping buckets, cubes, clumps and columns.

Every moment comes from one aggregate with partial sums; grouping is a key and never a pass for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.missing import col, known, signed, valid

from .quantiles import PERCENTILES, percentile_name, weighted_quantiles

MOMENTS = ("size", "count", "d_count", "mean_wt", "sum", "mean", "sum_square", "mean_square", "variance", "std_dev", "std_err", "t_stat", "min", "max")


def moments(x: str | Column, w: str | Column | None = None) -> dict[str, Column]:
    """Aggregate expressions by name. Weighted variance is centred by covariances, so it does not cancel."""
    ok = valid(x, w)
    v = F.when(ok, known(x))
    n = F.count(v)
    if w is None:
        mean, square, total = F.avg(v), F.avg(v * v), n.cast("double")
        variance, d_count, mean_wt = F.var_pop(v), n.cast("double"), F.when(n > 0, F.lit(1.0))
    else:
        u = F.when(ok, known(w))
        total = F.sum(u)
        mean, square = F.sum(u * v) / total, F.sum(u * v * v) / total
        lean = F.covar_pop(u, v) / F.avg(u)
        variance = F.greatest((F.covar_pop(u * v, v) - F.avg(v) * F.covar_pop(u, v)) / F.avg(u) - lean * lean, F.lit(0.0))
        d_count, mean_wt = total * total / F.sum(u * u), F.avg(u)
    variance = F.when(n > 1, variance)
    std_dev = F.sqrt(variance)
    std_err = std_dev / F.sqrt(d_count)
    return {
        "size": F.count(F.lit(1)),
        "count": n,
        "d_count": d_count,
        "mean_wt": mean_wt,
        "sum": mean * n,
        "mean": mean,
        "sum_square": square * n,
        "mean_square": square,
        "variance": variance,
        "std_dev": std_dev,
        "std_err": std_err,
        "t_stat": F.when(std_err > 0, F.try_divide(mean, std_err)),
        "min": F.min(v),
        "max": F.max(v),
    }


def extremes(x: str | Column, pos: str | Column, w: str | Column | None = None) -> dict[str, Column]:
    """min and max with the id of their first occurrence."""
    v = F.when(valid(x, w), known(x))
    low = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), col(pos).alias("p"))))
    high = F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-col(pos)).alias("p"))))
    return {"min": low["v"], "min_id": low["p"], "max": high["v"], "max_id": -high["p"]}


#: Registry of aggregates by name, for callers that choose a statistic at run time; `register` adds one.
AGGREGATES: dict[str, Callable[[Column, Column | None], Column]] = {name: (lambda x, w=None, name=name: moments(x, w)[name]) for name in MOMENTS}


def register(name: str, build: Callable[[Column, Column | None], Column]) -> None:
    AGGREGATES[name] = build


def _round(columns: dict[str, Column], digits: int | None) -> list[Column]:
    return [(c if digits is None or name in ("size", "count") else F.round(c, digits)).alias(name) for name, c in columns.items()]


def summary(df: DataFrame, value: str | Column, weight: str | Column | None = None, *, by: Sequence[str] = (), statistics: Sequence[str] = MOMENTS, quantiles: Sequence[float] = (), mad: bool = False, order: Sequence[Column] = (), negative_weights: bool = False, digits: int | None = None) -> DataFrame:
    """One row for each group (or one): moments, interpolated weighted quantiles and the mean absolute deviation's median."""
    if negative_weights:
        value, weight = signed(value, weight)
    all_of = moments(value, weight)
    out = df.groupBy(*by).agg(*_round({s: all_of.get(s, None) if s in all_of else AGGREGATES[s](col(value), weight) for s in statistics}, digits))
    if quantiles or mad:
        ranked = weighted_quantiles(df, value, weight, by=by, quantiles=quantiles, mad=mad, order=order)
        names = [percentile_name(q) for q in quantiles] + (["mad"] if mad else [])
        ranked = ranked.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], *[(F.col(n) if digits is None else F.round(n, digits)).alias(n) for n in names])
        if by:
            same = F.lit(True)
            for i, b in enumerate(by):
                same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
            out = out.join(ranked, same, "left").drop(*[f"_k{i}" for i in range(len(by))])
        else:
            out = out.join(F.broadcast(ranked), how="left")
    return out


def full_summary(df: DataFrame, value: str | Column, weight: str | Column | None = None, **options) -> DataFrame:
    return summary(df, value, weight, quantiles=PERCENTILES, mad=True, **options)


def with_total(df: DataFrame, by: str, aggregates: Sequence[Column], *, label: str = "label", total: str = "All") -> DataFrame:
    """Groups and a grand total, in one pass (rollup)."""
    rolled = df.rollup(by).agg(*aggregates, F.grouping_id().alias("_g"))
    return rolled.withColumn(label, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(by).cast("string"))).drop(by, "_g")


def bucketed(df: DataFrame, buckets: dict[str, Column], aggregates: Sequence[Column], *, label: str = "label", other: str | None = "Other", total: str | None = None) -> DataFrame:
    """Named conditions, which may overlap: a row counts in each that holds, or in `other`. No NULL condition holds."""
    held = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in buckets.items()]
    found = F.array_compact(F.array(*held))
    if other is not None:
        found = F.when(F.size(found) == 0, F.array(F.lit(other))).otherwise(found)
    if total is not None:
        found = F.concat(F.array(F.lit(total)), found)
    return df.withColumn(label, F.explode(found)).groupBy(label).agg(*aggregates)


def bin_label(x: str | Column, splits: Sequence[float], *, other: str = "Other") -> Column:
    """'_s0', 's0_s1', ... 'sn_' by [s, next); missing values are `other`."""
    v = known(x)
    names = [f"{s:g}" for s in splits]
    out = F.when(v.isNull(), F.lit(other)).when(v < splits[0], F.lit(f"_{names[0]}"))
    for i in range(1, len(splits)):
        out = out.when(v < splits[i], F.lit(f"{names[i - 1]}_{names[i]}"))
    return out.otherwise(F.lit(f"{names[-1]}_"))


def bucket_cube(df: DataFrame, bins: dict[str, Column], aggregates: Sequence[Column], *, label: str = "label", total: str = "All") -> DataFrame:
    """All combinations of the fields' bins and of their totals; labels joined by '|'."""
    names = [f"_b{i}" for i in range(len(bins))]
    cube = df.withColumns(dict(zip(names, bins.values()))).cube(*names).agg(*aggregates, *[F.grouping(n).alias(f"_g{i}") for i, n in enumerate(names)])
    parts = [F.when(F.col(f"_g{i}") == 1, F.lit(total)).otherwise(F.col(n)) for i, n in enumerate(names)]
    return cube.withColumn(label, F.concat_ws("|", *parts)).drop(*names, *[f"_g{i}" for i in range(len(names))])


def clump(pos: str | Column, step: int | Sequence[int]) -> Column:
    """Index of the clump of consecutive rows that a 0-based position lies in; the last length of a list repeats."""
    p = col(pos)
    if isinstance(step, int):
        return F.floor(p / step).cast("long")
    edges, out, total = [], None, 0
    for n in step:
        total += n
        edges.append(total)
    out = F.lit(None).cast("long")
    for i, e in reversed(list(enumerate(edges))):
        out = F.when(p < e, F.lit(i).cast("long")).otherwise(F.floor((p - F.lit(edges[-1])) / step[-1]).cast("long") + len(edges) if out is None or i == len(edges) - 1 else out)
    return out


def clump_start(pos: str | Column, step: int | Sequence[int]) -> Column:
    p = col(pos)
    if isinstance(step, int):
        return (F.floor(p / step) * step).cast("long")
    out, total, edges = None, 0, []
    for n in step:
        edges.append((total, total + n))
        total += n
    out = (F.floor((p - F.lit(total)) / step[-1]) * step[-1] + total).cast("long")
    for lo, hi in reversed(edges):
        out = F.when(p < hi, F.lit(lo).cast("long")).otherwise(out)
    return out


def unpivoted(df: DataFrame, values: Sequence[str], ids: Sequence[str] = (), *, name: str = "variable", value: str = "value") -> DataFrame:
    """Columns as rows, for statistics along the other axis or for a loop over variables."""
    return df.select(*ids, F.explode(F.array(*[F.struct(F.lit(v).alias(name), known(v).alias(value)) for v in values])).alias("_u")).select(*ids, f"_u.{name}", f"_u.{value}")


def column_summary(df: DataFrame, spec: Sequence[str], weight: str | None = None, *, by: Sequence[str] = (), statistic: str = "mean") -> DataFrame:
    """`spec` entries are 'field', 'field/Name' and '...%format' (the format goes to the column's metadata)."""
    out = [F.count(F.lit(1)).alias("count")]
    if weight:
        u = F.when(known(weight) > 0, known(weight))
        out += [(F.sum(u) * F.sum(u) / F.sum(u * u)).alias("d_count"), F.avg(u).alias("mean_weight")]
    for entry in spec:
        body, _, fmt = entry.partition("%")
        field, _, name = body.partition("/")
        out.append(moments(field, weight)[statistic].alias(name or field, metadata={"format": f"%{fmt}"} if fmt else {}))
    return df.groupBy(*by).agg(*out)


def gini(df: DataFrame, count: str, income: str, by: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient of groups of `count` people with `income` each."""
    from paneloom.plans.ranking import running
    from paneloom.plans.shared import checked_broadcast, materialize

    base = df.where(valid(income, count)).select(*by, known(count).alias("_n"), known(income).alias("_m"))
    cum = running(base, by, [F.col("_m")], {"_upto": F.col("_n")})
    total = base.groupBy(*by).agg(F.sum("_n").alias("_p"), F.sum(F.col("_n") * F.col("_m")).alias("_s"))
    joined = cum.join(checked_broadcast(materialize(total, "totals")), list(by)) if by else cum.crossJoin(F.broadcast(total))
    above = F.col("_p") - F.col("_upto") + F.col("_n") / 2
    return joined.groupBy(*by).agg((1 - 2 * F.sum(F.col("_n") * F.col("_m") / F.col("_s") * above / F.col("_p"))).alias("gini"))


def theil(df: DataFrame, count: str, income: str, by: Sequence[str] = ()) -> DataFrame:
    n, m = known(count), known(income)
    base = df.where(valid(income, count) & (m > 0))
    mean = F.sum(n * m) / F.sum(n)
    # sum n m ln(m / mean) / sum n m, expanded so that one aggregate does
    return base.groupBy(*by).agg((F.sum(n * m * F.ln(m)) / F.sum(n * m) - F.ln(mean)).alias("theil"))
