"""Text tables: an optional header of '#fields', '#types', '#formats', '#separator' lines, then one row for each line.

The header is the block of lines that begin with '#' at the head of the first file, however long; such lines further down are
comments. Only the first split of that file is looked at for it, by one task that stops where the block ends. Rows are split,
filtered and typed in the scan's own projection, file splits in parallel. Compressed files (.gz) are read as they are, also
where only the name without .gz is given. Spark's own text reader is used, and no Python one, as it reads any store and cuts
files at line ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names of headers and specs -> Spark type, default format, default value.
TYPES = {
    "double": (T.DoubleType(), "%9.6f", float("nan")),
    "float": (T.DoubleType(), "%9.6f", float("nan")),
    "long": (T.LongType(), "%9d", 0),
    "int": (T.LongType(), "%9d", 0),
    "bool": (T.BooleanType(), "%1d", False),
    "string": (T.StringType(), "%-s", ""),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "double"
    format: str | None = None
    default: object = None

    def spark(self) -> T.StructField:
        base = re.match(r"[a-z]+", self.type.lower())
        kind, fmt, default = TYPES.get(base[0] if base else "", TYPES["double"])
        width = re.search(r"\((\d+)\)", self.type)
        if isinstance(kind, T.StringType) and width:
            fmt = f"%-{width[1]}s"
        meta = {"format": self.format or fmt}
        value = default if self.default is None else self.default
        if value == value:  # NaN has no place in JSON metadata
            meta["default"] = value
        return T.StructField(self.name, kind, True, meta)


def schema_of(spec: Sequence[Field | tuple]) -> T.StructType:
    return T.StructType([(f if isinstance(f, Field) else Field(*f)).spark() for f in spec])


def found_path(spark: SparkSession, path: str) -> str | None:
    """The path, or the compressed file beside a missing bare one; None if there is neither."""
    for name in (path, f"{path}.gz"):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        matches = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        if matches is not None and len(matches):
            return name
    return None


def leading_block(spark: SparkSession, path: str) -> list[str]:
    """The lines at the head of the first file, by name, that begin with '#'."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return []
    first = spark.read.text(files[0]).where(F.col("_metadata.file_block_start") == 0).select("value")

    def head(batches):
        import pyarrow as pa

        for b in batches:
            lines = []
            for line in b.column(0).to_pylist():
                if not line.startswith("#"):
                    break
                lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
            if len(lines) < len(b):
                return

    return [r[0] for r in first.mapInArrow(head, "value string").collect()]


def read_header(lines: Iterable[str]) -> tuple[list[Field], str | None]:
    """Fields and separator from the leading '#' lines; lists of unequal length are an error."""
    parts: dict[str, list[str]] = {}
    separator = None
    for line in lines:
        if not line.startswith("#"):
            break
        key, _, rest = line[1:].strip().partition(" ")
        if key == "separator":
            separator = rest.strip() or None
        elif key in ("fields", "types", "formats"):
            parts[key] = rest.split()
    names = parts.get("fields", [])
    for key in ("types", "formats"):
        if key in parts and len(parts[key]) != len(names):
            raise ValueError(f"{len(names)} fields but {len(parts[key])} {key}")
    kinds, formats = parts.get("types", ["double"] * len(names)), parts.get("formats", [None] * len(names))
    return [Field(n, t, f) for n, t, f in zip(names, kinds, formats)], separator


def read_text_table(spark: SparkSession, path: str, spec: Sequence[Field | tuple] | None = None, *, separator: str | None = None, match_pattern: str | None = None, select_fields: Sequence[str] | None = None, skip_fields: Sequence[str] | None = None, select_field_values: dict | None = None, skip_field_values: dict | None = None, add_spec: Sequence[Field | tuple] = (), default_missing: bool = False, sort: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """A typed table. `separator` is a regular expression (default: white space); values are filtered before typing."""
    if select_fields is not None and skip_fields is not None:
        raise ValueError("give select_fields or skip_fields, not both")
    found = found_path(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    lines = spark.read.text(found)
    if spec is None:
        spec, own = read_header(leading_block(spark, found))
        separator = re.escape(own) if own else separator
    fields = [f if isinstance(f, Field) else Field(*f) for f in spec]
    names = [f.name for f in fields]
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    if match_pattern:
        rows = rows.where(F.col("value").rlike(match_pattern))
    tokens = F.split(F.trim("value"), separator or r"\s+")
    rows = rows.select(*[F.get(tokens, F.lit(i)).alias(n) for i, n in enumerate(names)])
    for f, values in (select_field_values or {}).items():
        rows = rows.where(F.col(f).isin([str(v) for v in values]))
    for f, values in (skip_field_values or {}).items():
        rows = rows.where(~F.coalesce(F.col(f).isin([str(v) for v in values]), F.lit(False)))
    chosen = [f for f in fields if (select_fields is None or f.name in select_fields) and f.name not in (skip_fields or ())]
    if not chosen:
        raise ValueError("no fields are left")
    out = []
    for f in chosen:
        s = f.spark()
        c = F.nullif(F.trim(f.name), F.lit("#NA")) if not isinstance(s.dataType, T.StringType) else F.when(F.col(f.name) != "#NA", F.col(f.name))
        c = c.try_cast(s.dataType)
        if default_missing and f.default is not None:
            c = F.when(c.isNull() | (F.trim(F.col(f.name)) == ""), F.lit(f.default).cast(s.dataType)).otherwise(c)
        out.append(c.alias(f.name, metadata=s.metadata))
    for f in (f if isinstance(f, Field) else Field(*f) for f in add_spec):
        s = f.spark()
        out.append(F.lit(f.default if f.default is not None else TYPES[f.type][2]).cast(s.dataType).alias(f.name, metadata=s.metadata))
    table = rows.select(*out)
    if sort:
        table = table.orderBy(*[F.col(c).desc_nulls_first() if reverse else F.col(c).asc_nulls_last() for c in sort])
    return table


def from_rows(spark: SparkSession, rows: Sequence[tuple | dict], spec: Sequence[Field | tuple], *, process_nones: bool = False) -> DataFrame:
    """Tuples, or dicts with keys that may be missing; with `process_nones` NULLs become the fields' defaults."""
    schema = schema_of(spec)
    made = [tuple(r.get(f.name) for f in schema) if isinstance(r, dict) else tuple(r) for r in rows]
    df = spark.createDataFrame([tuple(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v for f, v in zip(schema, r)) for r in made], schema)
    if process_nones:
        df = df.select(*[F.coalesce(F.col(f.name), F.lit(f.metadata.get("default", float("nan"))).cast(f.dataType)).alias(f.name, metadata=f.metadata) for f in schema])
    return df


def read_keyed_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """CSV with a header and a unique key: a missing key column is a KeyError, a repeated key a ValueError."""
    df = spark.read.csv(path, header=True)
    if key not in df.columns:
        raise KeyError(key)
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")
    return df
