"""Rendering and writing tables: padded text, typed headers, files of arrays, keyed stores."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of statistics tables in the order they are shown, with their formats, and those shown by default.
STATISTICS = {
    "size": "%7d", "count": "%7d", "d_count": "%8.1f", "mean_wt": "%7.3f", "sum": "%8.1f", "mean": "%8.4f", "std_dev": "%8.4f", "t_stat": "%7.3f", "median": "%8.4f", "mad": "%8.4f",
    "p25": "%8.4f", "p75": "%8.4f", "p10": "%8.4f", "p90": "%8.4f", "correlation": "%7.4f", "multiple": "%10.6f", "std_err": "%8.6f", "variance": "%8.6f", "min": "%8.3f", "max": "%8.3f",
}
SHORT = ("count", "d_count", "mean_wt", "mean", "std_dev", "correlation", "t_stat", "median", "mad", "min", "max")

_NAMES = {T.DoubleType: "double", T.FloatType: "double", T.LongType: "long", T.IntegerType: "long", T.BooleanType: "bool", T.StringType: "string"}


def format_of(field: T.StructField) -> str:
    return field.metadata.get("format") or {"double": "%9.6f", "long": "%9d", "bool": "%1d"}.get(_NAMES.get(type(field.dataType), "string"), "%s")


def chosen(df: DataFrame, fields: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> list[T.StructField]:
    names = [f for f in (fields or df.columns) if f not in exclude]
    return [df.schema[n] for n in names]


def header(df: DataFrame, *, spec: bool = True, fields: Sequence[str] | None = None, exclude: Sequence[str] = (), rename: dict[str, str] | None = None, delimiter: str = " ") -> str:
    """Three typed lines ('#fields', '#types', '#formats'), or one line of names."""
    picked = chosen(df, fields, exclude)
    names = [(rename or {}).get(f.name, f.name) for f in picked]
    if not spec:
        return delimiter.join(names)
    return "\n".join(["#fields " + delimiter.join(names), "#types " + delimiter.join(_NAMES.get(type(f.dataType), "string") for f in picked), "#formats " + delimiter.join(format_of(f) for f in picked)])


def line(df: DataFrame, *, fields: Sequence[str] | None = None, exclude: Sequence[str] = (), delimiter: str = " ") -> Column:
    """A row as text: each value by its format; '#NA' for missing or empty."""
    parts = []
    for f in chosen(df, fields, exclude):
        c, fmt = F.col(f.name), format_of(f)
        if isinstance(f.dataType, T.BooleanType):
            text = c.cast("int").cast("string")
        elif fmt in ("%s", "%-s"):
            text = c.cast("string")
        else:
            text = F.format_string(fmt, c)
        gone = c.isNull() | F.isnan(c.cast("double")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()
        if isinstance(f.dataType, T.StringType):
            gone = gone | (c == "")
        parts.append(F.when(gone, F.lit("#NA")).otherwise(text))
    return F.concat_ws(delimiter, *parts)


def write_text_table(df: DataFrame, path: str, *, append: bool = False, compress: bool = False, delimiter: str = " ", **options) -> None:
    """Part files of lines. A new table's first part file holds its header, which is where `read_text_table` looks for it;
    appended parts have none. Appending to a compressed table is refused."""
    if append and compress:
        raise ValueError("cannot append to a compressed table")
    rows = df.select(line(df, delimiter=delimiter, **options).alias("value"))
    if not append:
        head = df.sparkSession.createDataFrame([(x,) for x in header(df, delimiter=delimiter, **options).split("\n")], "value string").coalesce(1)
        rows = head.unionAll(rows)
    rows.write.mode("append" if append else "errorifexists").option("compression", "gzip" if compress else "none").text(path)


def to_string(df: DataFrame, *, limit: int = 1000, spec: bool = False, **options) -> str:
    """The first rows as text, for reports."""
    return "\n".join([header(df, spec=spec, **options), *[r[0] for r in df.select(line(df, **options).alias("v")).limit(limit).collect()]])


def statistics_table(df: DataFrame, *, label: str = "label", include: Sequence[str] = (), exclude: Sequence[str] = (), all: bool = False) -> DataFrame:
    """Statistics in their fixed order and formats: the short list with `include` added in place, or all of them. The label
    comes first; statistics outside the fixed list come last, by name, where `include` or `all` asks for them."""
    known = [s for s in STATISTICS if s in df.columns and (all or s in SHORT or s in include) and s not in exclude]
    other = sorted(c for c in df.columns if c not in STATISTICS and c != label and (all or c in include) and c not in exclude)
    return df.select(*([label] if label in df.columns else []), *[F.col(s).alias(s, metadata={"format": STATISTICS[s]}) for s in known], *other)


def save_arrays(spark: SparkSession, arrays: Iterable[Sequence[float]], path: str, select: Sequence[bool] | None = None) -> None:
    """Arrays in sequence as Parquet, one row for each value; `select` keeps the same places of each."""
    frames = []
    for i, a in enumerate(arrays):
        values = np.asarray(a, np.float64)
        values = values if select is None else values[np.asarray(select, bool)]
        frames.append(pd.DataFrame({"array_index": np.full(len(values), i, np.int32), "place": np.arange(len(values)), "value": values}))
    rows = pd.concat(frames) if frames else []
    spark.createDataFrame(rows, "array_index int, place long, value double").write.partitionBy("array_index").parquet(path)


def load_arrays(spark: SparkSession, path: str, *, start: int = 0, end: int | None = None, arrays: Sequence[int] | None = None, select: Sequence[bool] | None = None) -> DataFrame:
    """array_index, place, value of the arrays in [start, end), or of those listed; other partitions are not read. `select`
    keeps the same places of each and numbers them anew."""
    df = spark.read.schema("place long, value double, array_index int").parquet(path).where(F.col("array_index") >= start)
    df = df if end is None else df.where(F.col("array_index") < end)
    df = df if arrays is None else df.where(F.col("array_index").isin(list(arrays)))
    if select is None:
        return df
    places = np.flatnonzero(np.asarray(select, bool))
    kept = spark.createDataFrame(pd.DataFrame({"place": places, "_new": np.arange(len(places))}), "place long, _new long")
    return df.join(kept, "place").select(F.col("_new").alias("place"), "value", "array_index")


def write_store(df: DataFrame, path: str, table: str = "tbl") -> None:
    """A keyed store: (table, key, value) rows partitioned by table."""
    df.write.mode("overwrite").partitionBy(table).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _tables_of(batches: Iterable) -> Iterable:
    """Rows of the key-value tables in SQLite files; values that are pickled may hold plain data only."""
    import io
    import pickle
    import sqlite3

    class Plain(pickle.Unpickler):
        def find_class(self, module, name):
            raise pickle.UnpicklingError(f"{module}.{name} is not plain data")

    def text(v):
        if isinstance(v, bytes):
            v = Plain(io.BytesIO(v)).load()
        return None if v is None else str(v)

    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            base = sqlite3.connect(":memory:")
            base.deserialize(content.as_py())
            for (name,) in base.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
                quoted = '"' + name.replace('"', '""') + '"'
                if {"key", "value"} <= {r[1] for r in base.execute(f"PRAGMA table_info({quoted})")}:
                    cursor = base.execute(f"SELECT key, value FROM {quoted} ORDER BY rowid")
                    while rows := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([name] * len(rows)), pa.array([str(k) for k, _ in rows]), pa.array([text(v) for _, v in rows], pa.string())], names=["path", "tbl", "key", "value"])


def read_sqlite_store(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """path, tbl, key, value of the key-value tables in the SQLite file or files at `path` (a task for each file, through
    Spark's own reader, so they may be in any store)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_tables_of, "path string, tbl string, key string, value string")
    return rows if table is None else rows.where(F.col("tbl") == table)
