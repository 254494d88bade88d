"""Cutting lineage in the shared folder, and joins that broadcast only a side whose size was measured."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side of a join may be broadcast; beyond either, the join shuffles.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 << 20

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and all of Spark is on this machine, one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = getattr(spark.sparkContext, "_paneloom_folder", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="paneloom-")
            spark.sparkContext._paneloom_folder = folder
            _delete_at_end(spark, folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """The file system deletes it when the driver's JVM ends, whether or not the session was stopped before."""
    p, system = _path(spark, path)
    system.deleteOnExit(p)


def written_later(spark: SparkSession, path: str) -> None:
    """Have a folder that something else writes deleted like a materialized table."""
    _delete_at_end(spark, path)
    _written.append(path)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: every executor can read it, whoever is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/paneloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_end(spark, path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for `clear`."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables materialized since a mark, but for those that `keep` reads. What was built on them can't run again."""
    files = " ".join(keep.inputFiles()) if keep is not None else ""
    rest = [p for p in _written[since:] if p.rpartition("/")[2] in files]
    for path in _written[since:]:
        if path not in rest:
            p, system = _path(spark, path)
            system.delete(p, True)
    _written[since:] = rest


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in a hashed relation, from its values: 8 for each column and what strings, arrays and structs hold."""

    def held(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(c) + F.lit(8)
        if isinstance(kind, T.ArrayType):
            return F.aggregate(c, F.lit(16).cast("long"), lambda n, x: n + F.coalesce(held(x, kind.elementType).cast("long"), F.lit(0)) + 8)
        if isinstance(kind, T.StructType):
            return sum((F.coalesce(held(c[f.name], f.dataType).cast("long"), F.lit(0)) + 8 for f in kind), F.lit(16))
        if isinstance(kind, T.MapType):
            return held(F.map_keys(c), T.ArrayType(kind.keyType)) + held(F.map_values(c), T.ArrayType(kind.valueType))
        return F.lit(0)

    total = F.lit(32 + 8 * len(df.columns)).cast("long")
    for f in df.schema:
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            total = total + F.coalesce(held(F.col(f"`{f.name}`"), f.dataType).cast("long"), F.lit(0))
    return total


def checked_broadcast(small: DataFrame) -> DataFrame:
    """`small` with a broadcast hint if its rows and the bytes of their values, as measured, are within the bounds, else as
    it is (then the join shuffles). `small` should be a materialized table: it is read here."""
    rows, held = small.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(small))).first()
    return F.broadcast(small) if rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else small
