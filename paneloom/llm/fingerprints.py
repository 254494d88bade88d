"""Canonical exact digests of documents.

The canonical form is NFKC normalisation, full case folding, NFKC again, runs of white space turned into one space, and
trimming; the fingerprint is 128 bits of xxhash over its bytes. Normalisation and folding are the JVM's ICU, which comes
with Spark, called by the SQL function `reflect`; everything else is SQL too.

A document's next document (descending id, after the last the first) is found in ranges of ids whose bounds are quantiles
of the ids themselves, so a bound is a document, sent to both ranges it touches; there is no window over the whole table.
A range is a sorted group that may spill; there are at most MOST_RANGES, as many tasks as the step can use. Each text is
made canonical once before that step, its edited text once after it.

Documents are grouped by fingerprint on two longs and an id, pre-aggregated before the shuffle. Only groups of two or
more are asked for their text again: each member's canonical bytes are compared with those of the group's smallest id, and
members that differ (a collision) form classes by their bytes. A group of more than SPLIT_ROWS is split by a hash of the
id, and the head goes to each part; nothing is collected.

Defined results: a null text is the empty text; a null id comes last; rows of equal id follow in the order of their texts;
an empty table gives no rows; a lone document is its own next; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneloom.plans.shared import checked_broadcast, materialize

#: Ranges of ids at most, and members of a group that are compared in one part.
MOST_RANGES, SPLIT_ROWS = 100_000, 500
_NORMALIZER, _CHARACTERS = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    def nfkc(c: Column) -> Column:
        return F.reflect(F.lit(_NORMALIZER), F.lit("compose"), c, F.lit(True))

    folded = nfkc(F.reflect(F.lit(_CHARACTERS), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x1C-\x1F\x85]+", " "))


def wide_hash(canon: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), canon)), 16, "0")))


def fingerprint(text: Column) -> Column:
    return wide_hash(canonical(text))


def likeness(a: Column, b: Column) -> Column:
    """Exact digests are alike or they are not."""
    return (a == b).cast("double")


def with_next(df: DataFrame, *, range_rows: int = 500) -> DataFrame:
    """doc_id, text, fingerprint -> the same, and next_text, next_fingerprint."""
    # Rows are spread over ranges of -1 - id, which any id has; a null id counts as beyond the last.
    at = F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))
    total, ends = df.agg(F.count(F.lit(1)), F.percentile_approx(at, [0.0, 1.0], 10_000)).first()
    if not total:
        return df.withColumns({"next_text": F.col("text"), "next_fingerprint": F.col("fingerprint")})
    n = int(min(MOST_RANGES, max(1, total // range_rows)))
    cuts = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0] if n > 1 else []
    cuts = sorted(set(cuts) - {ends[1]})
    first = df.agg(F.min(at)).first()[0]
    placed = df.withColumn("_at", at)
    placed = placed.withColumn("_range", F.expr(_slot(cuts)))
    # the first row of all follows the last; a row on a bound also closes the range before
    places = [F.struct(F.col("_range").alias("range"), F.lit(False).alias("ghost")), F.when(F.col("_at") == F.lit(first), F.struct(F.lit(len(cuts)).alias("range"), F.lit(True).alias("ghost")))]
    if cuts:
        bound = F.get(F.lit(cuts).cast("array<bigint>"), F.col("_range") - 1)
        places.append(F.when(F.col("_at") == bound, F.struct((F.col("_range") - 1).alias("range"), F.lit(True).alias("ghost"))))
    placed = placed.withColumn("_p", F.explode(F.array_compact(F.array(*places))))
    placed = placed.select("doc_id", "text", "fingerprint", "_at", F.col("_p.range").alias("_range"), F.col("_p.ghost").alias("_ghost"))
    # ghosts follow all rows of their range; of several with one id the first by text is the next document
    order = W.partitionBy("_range").orderBy(F.col("_ghost"), F.col("_at"), F.col("doc_id").isNull(), F.col("text").asc_nulls_first(), "fingerprint")
    after = placed.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)})
    return after.where(~F.col("_ghost")).select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def _slot(cuts: list[int]) -> str:
    """SQL: how many cuts are at or below _at, by halving the array of cuts."""
    if not cuts:
        return "0"
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    held = f"array({','.join(f"BIGINT('{c}')" for c in cuts)})"
    return f"aggregate(array({','.join(map(str, steps))}), 0, (p, s) -> IF(p + s <= {len(cuts)} AND get({held}, p + s - 1) <= _at, p + s, p))"


def classes(digests: DataFrame, texts: DataFrame) -> DataFrame:
    """digests: doc_id, fingerprint; texts: doc_id, text. -> doc_id, fingerprint, class_id of members of groups of two or more.

    class_id is the smallest id of those with equal canonical bytes.
    """
    groups = digests.groupBy("fingerprint").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    shared = materialize(groups.where("_rows > 1"), "shared")
    ids = materialize(digests.join(checked_broadcast(shared.select("fingerprint")), "fingerprint", "left_semi").select("doc_id").distinct(), "ids")
    again = texts.join(checked_broadcast(ids.select(F.col("doc_id").alias("_id"))), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    members = again.select("doc_id", canonical(F.col("text")).alias("_canon")).withColumn("fingerprint", wide_hash(F.col("_canon")))
    parts = F.ceil(F.col("_rows") / F.lit(SPLIT_ROWS)).cast("int")
    members = members.join(checked_broadcast(shared.withColumn("_parts", parts)), "fingerprint")
    members = materialize(members.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int")), "members")
    heads = members.where(F.col("doc_id") == F.col("_first")).groupBy("fingerprint", "_parts").agg(F.min("_canon").alias("_head"))
    heads = heads.select("fingerprint", "_head", F.explode(F.expr("sequence(0, _parts - 1)")).alias("_part"))
    compared = members.join(heads, ["fingerprint", "_part"], "left").withColumn("_same", F.col("_canon").eqNullSafe(F.col("_head")))
    compared = materialize(compared.select("doc_id", "fingerprint", F.col("_first").alias("class_id"), F.when(~F.col("_same"), F.col("_canon")).alias("_odd")), "compared")
    odd = compared.where("_odd IS NOT NULL")
    by_bytes = odd.groupBy("fingerprint", "_odd").agg(F.min("doc_id").alias("class_id"))
    odd = odd.drop("class_id").join(by_bytes, ["fingerprint", "_odd"]).select("doc_id", "fingerprint", "class_id")
    return materialize(compared.where("_odd IS NULL").drop("_odd").union(odd).distinct(), "classes")


def edited_report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(texts.withColumn("fingerprint", fingerprint(F.col("text"))))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("_edited")).alias("edited_fingerprint"), "next_fingerprint")
    rows = rows.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))})
    rows = materialize(rows.drop("next_fingerprint"), "report")
    member = classes(rows.select("doc_id", "fingerprint"), texts)
    member = checked_broadcast(member.select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_print"), "class_id"))
    out = rows.join(member, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fingerprint") == F.col("_print")), "left").drop("_id", "_print")
    return out.withColumn("class_id", F.coalesce("class_id", "doc_id"))
