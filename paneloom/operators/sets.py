"""Upserts and set views of (table, key, value) rows, and a prefix index of sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(base: DataFrame, add: DataFrame, keys: Sequence[str], *, overwrite: bool = False, tables: Sequence[str] | None = None, table: str = "tbl") -> tuple[DataFrame, DataFrame]:
    """Rows after adding, and the keys that were skipped. With overwrite incoming rows win, else those present do."""
    if tables is not None:
        add = add.where(F.col(table).isin(list(tables)))
    keys = list(keys)
    if overwrite:
        return base.join(add.select(*keys), keys, "left_anti").unionByName(add), add.select(*keys).limit(0)
    return base.unionByName(add.join(base.select(*keys), keys, "left_anti")), add.join(base.select(*keys), keys, "left_semi").select(*keys)


def invert(df: DataFrame, *, table: str = "tbl", key: str = "key", exclude: Sequence[str] = (), include: Sequence[str] | None = None) -> DataFrame:
    """Key -> its table; of several the last by name."""
    rows = df.where(~F.col(table).isin(list(exclude))) if exclude else df
    rows = rows if include is None else rows.where(F.col(table).isin(list(include)))
    return rows.groupBy(key).agg(F.max(table).alias(table))


def table_sets(df: DataFrame, *, table: str = "tbl", key: str = "key") -> DataFrame:
    return df.groupBy(table).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def table_counts(df: DataFrame, *, table: str = "tbl", expr: Column | None = None, name: str = "value") -> DataFrame:
    """Rows of each table, or of each table and value of an expression."""
    by = [table] if expr is None else [table, expr.alias(name)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def nested_count(x: Column, depth: int = 1) -> Column:
    """Leaves of arrays nested `depth` deep."""
    for _ in range(depth - 1):
        x = F.flatten(x)
    return F.size(x).cast("long")


class Trie:
    """Sequences (arrays) as a table of their prefixes: exact membership and longest known prefix by equality joins."""

    def __init__(self, sequences: DataFrame, seq: str, idx: str):
        base = sequences.groupBy(F.col(seq).alias("seq")).agg(F.max(idx).alias("idx"))
        lengths = F.sequence(F.lit(1), F.size("seq"))
        nodes = base.where(F.size("seq") > 0).select(F.explode(F.transform(lengths, lambda k: F.struct(F.slice("seq", 1, k).alias("prefix"), F.when(k == F.size("seq"), F.col("idx")).alias("idx")))).alias("n"))
        self.nodes = nodes.select("n.prefix", "n.idx").groupBy("prefix").agg(F.max("idx").alias("idx"))
        self.leaves = base

    def contains(self, df: DataFrame, seq: str, name: str = "contained") -> DataFrame:
        leaves = self.leaves.select(F.col("seq").alias("_s"), F.lit(True).alias("_in"))
        return df.join(leaves, F.col(seq) == F.col("_s"), "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_s", "_in")

    def match(self, df: DataFrame, key: str, seq: str) -> DataFrame:
        """key, depth (longest prefix that is a prefix of some sequence), leaf (its index if it ends one)."""
        parts = df.select(F.col(key), F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size(seq), F.lit(1))), lambda k: F.slice(F.col(seq), 1, k))).alias("prefix"))
        hit = parts.join(self.nodes.withColumn("_in", F.lit(True)), "prefix", "left").withColumn("_d", F.when(F.col("_in"), F.size("prefix")).otherwise(F.lit(0)))
        best = hit.groupBy(key).agg(F.max(F.struct(F.col("_d").alias("d"), F.when(F.col("_in"), F.col("idx")).alias("idx"))).alias("m"))
        return best.select(key, F.col("m.d").alias("depth"), F.col("m.idx").alias("leaf"))
