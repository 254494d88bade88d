"""Connected components by hooking each root to its smallest neighbour and shortening paths, all in shuffled joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.plans.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """a, b -> id, component: the smallest id in reach, of every id that an edge names.

    Each round joins every root with a neighbour, so the number of rounds is logarithmic in the longest path.
    """
    links = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = links.union(links.select("b", "a"))
        parents = materialize(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "parents")
        while True:
            up = parents.select(F.col("a").alias("p"), F.col("p").alias("q"))
            shorter = materialize(parents.join(up, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "shorter")
            moved = shorter.where("moved").limit(1).count()
            parents = shorter.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = parents.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            up = parents.select(F.col("a").alias("component"), F.col("p").alias("q"))
            labels = materialize(labels.join(up, "component", "left").select("id", F.coalesce("q", "component").alias("component")), "labels")
        a, b = parents.select("a", F.col("p").alias("pa")), parents.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        links = materialize(links.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if not links.limit(1).count():
            return labels
