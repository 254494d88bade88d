"""Projections, selections, masks and the ordered mini-query of the table's output method."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneloom.functions.missing import col, known
from paneloom.plans.ranking import ONE_WINDOW_BYTES, beyond_one_window, global_ordinal


def project(df: DataFrame, fields: Sequence[str] | None = None, exclude: Sequence[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Columns in the order named, without `exclude`, renamed."""
    chosen = [f for f in (fields if fields is not None else df.columns) if f not in set(exclude)]
    if not chosen:
        raise ValueError("no fields are left")
    return df.select(*[F.col(f).alias((rename or {}).get(f, f)) for f in chosen])


def where_values(df: DataFrame, select: dict[str, Iterable] | None = None, skip: dict[str, Iterable] | None = None) -> DataFrame:
    """Rows whose fields are in (and not in) the value sets; all conditions hold."""
    for f, values in (select or {}).items():
        df = df.where(F.col(f).isin(list(values)))
    for f, values in (skip or {}).items():
        df = df.where(~F.coalesce(F.col(f).isin(list(values)), F.lit(False)))
    return df


def mask_out(df: DataFrame, columns: Sequence[str], overlay: Column) -> DataFrame:
    """Values that the overlay covers become missing; rows stay."""
    return df.withColumns({c: F.when(~F.coalesce(overlay, F.lit(False)), F.col(c)) for c in columns})


def fields_test(conditions: dict[str, tuple[float, int | None]]) -> Column:
    """{field: (value, code)}; codes 2 >, 1 >=, 0 =, -1 <=, -2 <, None <>. +1: all hold (or none asked), 0: some, -1: none."""
    tests = {2: lambda a, b: a > b, 1: lambda a, b: a >= b, 0: lambda a, b: a == b, -1: lambda a, b: a <= b, -2: lambda a, b: a < b, None: lambda a, b: a != b}
    if not conditions:
        return F.lit(1)
    held = sum((F.coalesce(tests[code](F.col(f), F.lit(v)), F.lit(False)).cast("int") for f, (v, code) in conditions.items()), F.lit(0))
    return F.when(held == len(conditions), F.lit(1)).when(held > 0, F.lit(0)).otherwise(F.lit(-1))


def membership(df: DataFrame, column: str, other: DataFrame, key: str, name: str = "member") -> DataFrame:
    """Boolean: is the value among the other table's keys?"""
    keys = other.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_in", F.lit(True))
    return df.join(keys, F.col(column) == F.col("_k"), "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_k", "_in")


def one_hot(x: str | Column, width: int) -> Column:
    """Array of booleans, true at the place of the value; none for 0 or less."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(i == col(x).cast("int"), F.lit(False)))


def repeat_array(x: Column, count: int) -> Column:
    return F.array_repeat(x, count)


def flatten_plane(x: Column) -> Column:
    return F.flatten(x)


def ordinal(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """0-based position in the order: one window for a small table, ranges and offsets for a large one."""
    if beyond_one_window(df, ONE_WINDOW_BYTES):
        return global_ordinal(df, order, name)
    return df.withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))


def slice_rows(df: DataFrame, order: Sequence[Column], start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """A Python slice of the rows in order; negative ends count from the end. A plain prefix is a top-k."""
    if step == 1 and (start or 0) == 0 and stop is not None and stop >= 0:
        return df.orderBy(*order).limit(stop)
    if step < 1:
        raise ValueError("step must be positive")
    n = df.count() if (start or 0) < 0 or (stop or 0) < 0 else None
    lo = max(0, (start or 0) + n) if (start or 0) < 0 else (start or 0)
    hi = None if stop is None else max(0, stop + n) if stop < 0 else stop
    at = ordinal(df, order, "_at").where(F.col("_at") >= lo)
    if hi is not None:
        at = at.where(F.col("_at") < hi)
    return at.where((F.col("_at") - lo) % step == 0).drop("_at")


def unique_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in order: an aggregate with partial minima, so a hot key is no task's own. Ascending, or
    descending numbers by `-column`."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*df.columns).distinct()
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])).alias("_row"))
    return got.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def sorted_known(df: DataFrame, key: str, reverse: bool = False, ties: Sequence[Column] = ()) -> DataFrame:
    """Sorted by a number; rows without it are dropped."""
    k = known(key)
    return df.where(k.isNotNull()).orderBy(k.desc() if reverse else k.asc(), *ties)


def constructor_sort(df: DataFrame, fields: Sequence[str], reverse: bool = False) -> DataFrame:
    """Sorted by fields, missing values last; `reverse` turns the whole order round."""
    return df.orderBy(*[F.col(f).desc_nulls_first() if reverse else F.col(f).asc_nulls_last() for f in fields])


def output(df: DataFrame, *, order: Sequence[Column], fields: Sequence[str] | None = None, exclude: Sequence[str] = (), rename: dict[str, str] | None = None, indices: Sequence[int] | None = None, sort: str | None = None, reverse: bool = False, sliced: tuple | None = None, select_values: dict | None = None, skip_values: dict | None = None, unique: Sequence[str] = ()) -> DataFrame:
    """Clauses in their fixed order: positions, sort, slice, value filters, first of each key, projection.

    `order` is the table's own order (positions refer to it); the result is sorted.
    """
    rows = ordinal(df, order, "_own")
    if indices is not None:
        rows = rows.where(F.col("_own").isin(list(indices)))
    now = [F.col("_own").desc() if reverse else F.col("_own").asc()]
    if sort is not None:
        rows = rows.where(known(sort).isNotNull())
        now = [known(sort).desc() if reverse else known(sort).asc(), *now]
    if sliced is not None:
        rows = slice_rows(rows, now, *sliced)
    rows = where_values(rows, select_values, skip_values)
    if unique:
        at = [F.col("_own"), *([] if sort is None else [known(sort)])][::-1]
        rows = unique_first(rows, unique, [-c if reverse else c for c in at])
    return project(rows.orderBy(*now).drop("_own"), fields, exclude, rename)


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """NULL and blank strings become the field's default."""
    kinds = dict(df.dtypes)
    out = {}
    for f, v in defaults.items():
        c = F.col(f)
        gone = c.isNull() | (F.trim(F.regexp_replace(c, r"\n", "")) == "") if kinds[f] == "string" else c.isNull()
        out[f] = F.when(gone, F.lit(v)).otherwise(c)
    return df.withColumns(out)


def add_fields(df: DataFrame, spec: Sequence[tuple]) -> DataFrame:
    """Appends columns (name, type, default)."""
    return df.withColumns({name: F.lit(default).cast(kind) for name, kind, default in spec})
