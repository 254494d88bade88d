"""Ordinals and running sums over a whole table, or over groups of any size, without a one-task window.

Tables whose rows are small in all, counted where Catalyst's estimate is small, use one window. Larger ones are range-partitioned by group and order; each range
is summed, the sums of the ranges (one row for each range and group) give the offsets, and a window runs inside a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import checked_broadcast, materialize

_LOW = (1 << 33) - 1
#: Bytes up to which one window (per group) is used: what one task sorts in memory.
ONE_WINDOW_BYTES = 64 << 20
#: Bytes of the files read up to which rows are not counted.
_FEW_BYTES = 256 << 10


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def beyond_one_window(df: DataFrame, most: int) -> bool:
    """Whether the rows may take more than `most` bytes. Catalyst's estimate is a share of compressed files, often a tenth of
    what their rows take or less; so where it is small the rows are counted, each of its columns' usual width."""
    if estimated_bytes(df) > most:
        return True
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) <= _FEW_BYTES:
        return False
    return df.count() * (df._jdf.schema().defaultSize() + 8) > most


def global_ordinal(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """0-based position of each row in the order given, by range partitions and their offsets.

    One range shuffle; the counts of the partitions (one row each) are all that meets on the driver.
    """
    spark = df.sparkSession
    sliced = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sliced = materialize(sliced.withColumns({"_in_slice": F.spark_partition_id(), "_place_in_slice": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))}), "ranked")
    counts = sorted((r["_in_slice"], r["n"]) for r in sliced.groupBy("_in_slice").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "_in_slice int, _slice_start long")
    placed = sliced.join(F.broadcast(starts), "_in_slice")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("_slice_start") + F.col("_place_in_slice")).alias(name))


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column], *, distributed: bool | None = None) -> DataFrame:
    """`df` with, for each name, the sum of its column over the group's rows up to this one in the order given."""
    if distributed is None:
        distributed = beyond_one_window(df, ONE_WINDOW_BYTES)
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if not distributed:
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    keyed = df.withColumns({f"_v_{name}": c for name, c in sums.items()})
    keys = [F.col(b).asc_nulls_first() for b in by] + list(order)
    sliced = materialize(keyed.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()), "sliced")
    totals = sliced.groupBy(*by, "_slice").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("_slice").alias("_s"), *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums])
    same = F.col("_slice") == F.col("_s")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    joined = sliced.join(checked_broadcast(materialize(totals, "offsets")), same)
    inside = W.partitionBy("_slice", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = joined.withColumns({name: F.sum(f"_v_{name}").over(inside) + F.col(f"_b_{name}") for name in sums})
    return out.select(*df.columns, *sums)


def running_last(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *, distributed: bool | None = None) -> DataFrame:
    """`df` with `value` filled by the last one that is not NULL in the group's rows up to this one in the order given."""
    if distributed is None:
        distributed = beyond_one_window(df, ONE_WINDOW_BYTES)
    if not distributed:
        return df.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    sliced = materialize(df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()), "sliced")
    lasts = sliced.where(F.col(value).isNotNull()).groupBy(*by, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    # a group spans consecutive ranges: each is given the last value before it
    empty = sliced.select(*by, "_slice", F.lit(None).cast(df.schema[value].dataType).alias("_last")).distinct()
    slices = materialize(lasts.unionByName(empty).groupBy(*by, "_slice").agg(F.first("_last", ignorenulls=True).alias("_last")), "lasts")
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select(F.col("_slice").alias("_s"), *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.last("_last", ignorenulls=True).over(before).alias("_before"))
    same = F.col("_slice") == F.col("_s")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    joined = sliced.join(checked_broadcast(materialize(carried, "carried")), same, "left")
    inside = W.partitionBy("_slice", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_before"))).select(*df.columns)
