"""Tables of records from any source, with the options of one constructor: a file, rows, a DataFrame, or nothing but a shape."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.operators.joins import last_by_key
from paneloom.operators.relational import ordinal

from .text_table import TYPES, Field, found_path, from_rows, read_text_table, schema_of


@dataclass(frozen=True)
class Records:
    """A table whose rows have places (`pos`, from 0), the field or fields it is indexed by, and the one that names a row."""

    table: DataFrame
    index: tuple[str, ...] = ()
    identifier: str | None = None
    pos: str = "pos"

    @property
    def rows(self) -> DataFrame:
        return self.table.drop(self.pos)

    def empty_record(self) -> dict:
        """Each field's default, for rows that are still to be filled."""
        return {f.name: _default(f) for f in self.table.schema if f.name != self.pos}

    def index_table(self) -> DataFrame:
        """Each key with the place of its last row."""
        if not self.index:
            raise ValueError("the table has no index")
        return self.table.groupBy(*self.index).agg(F.max(self.pos).alias(self.pos))

    def get(self, wanted: DataFrame, field: str, default=None) -> DataFrame:
        """`wanted` (the index fields as columns) with the field of the last row of that key; a miss gives the default, by
        default that of the field."""
        if not self.index:
            raise ValueError("the table has no index")
        last = last_by_key(self.table.select(*self.index, field, self.pos), list(self.index), self.pos)
        held = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.index)], F.struct(field).alias("_found"))
        same = F.lit(True)
        for i, k in enumerate(self.index):
            same = same & wanted[k].eqNullSafe(F.col(f"_k{i}"))
        missing = _default(self.table.schema[field]) if default is None else default
        value = F.when(F.col("_found").isNull(), F.lit(missing)).otherwise(F.col(f"_found.{field}"))
        return wanted.join(held, same, "left").select(*wanted.columns, value.alias(field))

    def sorted_by(self, fields: Sequence[str], reverse: bool = False) -> Records:
        """Rows in another order; ties stay in theirs."""
        order = [F.col(f).desc_nulls_first() if reverse else F.col(f).asc_nulls_last() for f in fields]
        placed = ordinal(self.table.withColumnRenamed(self.pos, "_was"), [*order, F.col("_was").desc() if reverse else F.col("_was")], self.pos)
        return Records(placed.drop("_was"), self.index, self.identifier, self.pos)


def _default(f: T.StructField):
    if "default" in f.metadata:
        return f.metadata["default"]
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return math.nan
    return next((d for kind, _, d in TYPES.values() if isinstance(f.dataType, type(kind))), None)


def _with_fields(df: DataFrame, spec: Sequence[Field | tuple]) -> DataFrame:
    for f in schema_of(spec):
        df = df.withColumn(f.name, F.lit(_default(f)).cast(f.dataType).alias(f.name, metadata=f.metadata))
    return df


def records(spark: SparkSession, source: str | DataFrame | Sequence | None = None, spec: Sequence[Field | tuple] | None = None, *, add_spec: Sequence[Field | tuple] = (), shape: int | tuple[int, ...] | None = None, index: str | Sequence[str] | None = None, identifier: str | None = None, sort: str | Sequence[str] | None = None, reverse: bool = False, process_nones: bool = False, default_missing: bool = False, none_ok: bool = True, pos: str = "pos", **reading) -> Records | None:
    """`source`: the path of a text table (`reading` goes to `read_text_table`), rows (tuples, dicts or None), a DataFrame, or
    None for `shape` records of `spec`'s defaults. A missing file gives None, or an error without `none_ok`."""
    if source is None:
        if shape is None or spec is None:
            raise ValueError("without a source, a shape and a spec are needed")
        df = _with_fields(spark.range(math.prod(shape) if isinstance(shape, tuple) else shape), spec).drop("id")
    elif isinstance(source, str):
        if found_path(spark, source) is None:
            if none_ok:
                return None
            raise ValueError(f"could not load {source}")
        df = read_text_table(spark, source, spec, default_missing=default_missing, **reading)
    elif isinstance(source, DataFrame):
        df = source
    else:
        if spec is None:
            raise ValueError("rows need a spec")
        width = len(spec)
        given = [r if r is not None else ((None,) * width if process_nones else None) for r in source]
        if any(r is None for r in given):
            raise ValueError("a row is None; with process_nones it becomes an empty record")
        df = from_rows(spark, given, spec, process_nones=process_nones)
        if default_missing:
            for f in (f if isinstance(f, Field) else Field(*f) for f in spec):
                if f.default is not None:
                    c = F.col(f.name)
                    gone = c.isNull() | (F.trim(c.cast("string")) == "")
                    df = df.withColumn(f.name, F.when(gone, F.lit(f.default).cast(df.schema[f.name].dataType)).otherwise(c).alias(f.name, metadata=df.schema[f.name].metadata))
    df = _with_fields(df, add_spec)
    keys = (index,) if isinstance(index, str) else tuple(index or ())
    placed = ordinal(df.withColumn("_was", F.monotonically_increasing_id()), [F.col("_was")], pos).drop("_was")
    out = Records(placed, keys, identifier or (keys[0] if keys else None), pos)
    return out.sorted_by([sort] if isinstance(sort, str) else list(sort), reverse) if sort else out
