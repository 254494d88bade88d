"""Cumulative-snapshot collapse of logged conversations, and rendering.

Logs keep a snapshot of a conversation after each turn. Every prefix of every conversation gets a 128-bit rolling hash:
the running xor of hashes of (position, role, text). A conversation whose whole hash is a prefix hash of a longer one is
a snapshot of it and goes, by an anti-join; of equal conversations the smallest id stays. Only then is anything rendered.

Prefix hashes are made distinct before they are shuffled on to the anti-join, so a first turn shared by a third of the
conversations is one row for each task. No pairs of conversations are made. A conversation is one window group and one
rendered string, so its own turns are what a task must hold.

Defined results: turns are ordered by turn, role, text (nulls first), rows repeated in the log are turns of their own; a
null role or text is hashed apart from an empty one and rendered as empty; rows with a null conv_id are one conversation;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneloom.plans.shared import checked_broadcast, materialize


def with_prefix_hashes(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, at (1-based), n_turns, h1, h2 (of the turns up to this one), role, text."""
    turns = df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("_turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = W.partitionBy("conv_id").orderBy("_turn", "role", "text")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    turns = turns.withColumns({"at": F.row_number().over(order), "n_turns": F.count(F.lit(1)).over(W.partitionBy("conv_id")).cast("int")})
    part = [F.col("at"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    turns = turns.withColumns({f"_p{i}": F.xxhash64(F.lit(i), *part) for i in (1, 2)})
    return turns.withColumns({f"h{i}": F.bit_xor(f"_p{i}").over(upto) for i in (1, 2)}).drop("_turn", "_p1", "_p2")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies (equal conversations, itself included) of those that no longer one extends."""
    light = materialize(turns.select("conv_id", "at", "n_turns", "h1", "h2"), "prefixes")
    longer = light.where(F.col("at") < F.col("n_turns")).select(F.col("at").alias("n_turns"), "h1", "h2").distinct()
    whole = light.where(F.col("at") == F.col("n_turns"))
    one = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return one.join(longer, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "copies")


def collapse_and_render(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", before: str = "<|im_start|>", after: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, copies, text of each maximal conversation."""
    turns = with_prefix_hashes(df, id_col, turn_col, role_col, text_col)
    kept = materialize(maximal_conversations(turns), "maximal").withColumnRenamed("conv_id", "_id")
    said = turns.select("conv_id", "at", "role", "text").join(checked_broadcast(kept), F.col("conv_id").eqNullSafe(F.col("_id")))
    message = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(after))
    rendered = said.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("at", message.alias("m")))).alias("_m"))
    return rendered.select("conv_id", "n_turns", "copies", F.array_join(F.transform("_m", lambda x: x["m"]), "\n").alias("text"))


ORACLE = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
c AS (SELECT conv_id, count(*) AS n, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY pos) AS text FROM t GROUP BY conv_id),
o AS (SELECT n, text, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY n, text)
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, copies, text FROM o
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > o.n AND starts_with(c.text, o.text || chr(10)))
"""
