"""Sampling without replacement. Ranks of random keys and top-k, so no row count is needed and nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneloom.functions.missing import known


def sample(df: DataFrame, count: int, *, weight: str | None = None, seed: int = 0) -> DataFrame:
    """`count` rows; with weights the chance of each next draw is its weight's share of what remains."""
    u = F.rand(seed)
    key = u if weight is None else -F.ln(1 - u) / known(weight)
    rows = df if weight is None else df.where(known(weight) > 0)
    return rows.withColumn("_u", key).orderBy("_u").limit(count).drop("_u")


def sample_keyed(df: DataFrame, count: int, key: Column) -> DataFrame:
    """`count` rows by an arithmetic hash of a unique integer, which any engine can repeat."""
    return df.orderBy((key * 1_103_515_245 + 12_345) % 2_147_483_648, key).limit(count)


def sample_each(df: DataFrame, columns: Sequence[str], count: int, *, seed: int = 0) -> DataFrame:
    """Each column sampled by itself: place and a value for each column."""
    from .stats import unpivoted

    rows = unpivoted(df, columns).withColumn("_u", F.rand(seed))
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("variable").orderBy("_u"))).where(F.col("place") <= count)
    return placed.groupBy("place").pivot("variable", list(columns)).agg(F.first("value"))


def sample_where(df: DataFrame, mask: Column, count: float, *, seed: int = 0) -> DataFrame:
    """Rows out of those where the mask holds; a count between 0 and 1 is their share (rounded down)."""
    chosen = df.where(mask)
    n = int(count * chosen.count()) if 0 < count < 1 else int(count)
    return sample(chosen, n, seed=seed)


def sample_mask(df: DataFrame, key: str, mask: Column, count: float, *, seed: int = 0, name: str = "sampled") -> DataFrame:
    """All rows, with a boolean for those sampled."""
    got = sample_where(df.select(key, *[c for c in df.columns if c != key]), mask, count, seed=seed).select(F.col(key).alias("_k"), F.lit(True).alias("_in"))
    return df.join(got, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_k", "_in")
