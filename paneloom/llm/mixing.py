"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources in code-point order (null last) weigh `weights` in turn and share `share` of all words; a target
stops at `max_copies` times its source's size, and the excess is shared again by weight until none is above.

Within a source every document is due floor(target / size) whole copies, which are certain. What the target leaves is drawn
by Pareto order sampling with unequal inclusion probabilities: p is proportional to 2 ** (grade * size_power) for a document
of 2 ** grade words or more, is 1 at most (such documents are certain too), and is scaled so that the words expected are
those that are left. A document's random odds U / (1 - U) are divided by its inclusion odds p / (1 - p), and the n documents
of least quotient are the sample, n being the sum of the probabilities: its size is fixed. U comes from md5(seed, doc_id),
so reruns agree.

The words of a fixed number of documents are random; in a source of many documents they come within `tolerance` of the
target, and the sample stands. In the others its end is moved along the same order until the words that are left are
reached. One more document, the one whose size comes closest to the words still missing, is then taken if that brings the
source nearer to its target. Where this leaves more than a thousandth of the target, the order goes on past the documents
that are larger than what is left, again and again until none fits; of these states, each with its own last document, the
one nearest to the target counts.

The cut in each source's order is found without sorting the source: documents or words are summed over 4096 ranges of the
quotient (pre-aggregated before the shuffle: at most 4096 rows for each source), the range that holds the cut is divided by
4096 again, and only what lies in that last range (a sixteen-millionth of the source) is put in order by a window.

Defined results: a null text has size 0 and is never short of anything; a source whose documents are all empty has target
0; repeated rows are separate documents of equal order; an empty table gives no rows; extra columns are ignored by
`mix_plan` and kept by `mix_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneloom.plans.ranking import global_ordinal
from paneloom.plans.shared import checked_broadcast, materialize

from .common import n_words

_RANGES = 4096
#: Sources up to which their order is a plain window; beyond, range partitions and offsets give it.
_PLAIN_SOURCES = 100_000


def uniform(doc_id: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of md5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_copies: int) -> DataFrame:
    """source, source_size -> source, source_size, target (materialized)."""
    order = [F.col("source").asc_nulls_last()]
    if sizes.limit(_PLAIN_SOURCES + 1).count() <= _PLAIN_SOURCES:
        ranked = sizes.withColumn("_r", F.row_number().over(W.orderBy(*order)) - 1)
    else:
        ranked = global_ordinal(sizes, order, "_r")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_copies))), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # The level rises until the sources that it fills to their caps stay the same; each round is one small aggregate.
    level, goal = 0.0, share * total
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        capped, open_weight = ranked.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if not open_weight:
            break
        risen = (goal - (capped or 0.0)) / open_weight
        if risen <= level:
            break
        level = risen
    return ranked.select("source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_w")).alias("target"))


def mix_plan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """For each row: doc_id, size, source, source_size, target, taken, copies, p (of inclusion in the sample), drawn (into the
    sample of fixed size); materialized. Options: weights, share, max_copies, seed, size_power, tolerance."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    return _plan(materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "sizes"), **options)


def inclusion(grades: DataFrame, rest: DataFrame, size_power: float) -> DataFrame:
    """_key, _grade, _n, _words and _key, _rest -> _key, _grade, _p: probabilities whose expected words are _rest.

    The highest grades are certain as far as the level that the others then get would bring them above 1.
    """
    graded = of_source(grades, rest).where("_words > 0 AND _rest > 0").withColumn("_h", F.pow(F.lit(2.0), F.col("_grade") * F.lit(float(size_power))))
    order = W.partitionBy("_key").orderBy(F.desc("_grade"))  # a row for each grade, 63 at most
    above = F.coalesce(F.sum("_words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("_rest") - above) / F.sum(F.col("_h") * F.col("_words")).over(order.rowsBetween(0, W.unboundedFollowing))
    graded = materialize(graded.withColumn("_level", F.when(level * F.col("_h") <= 1, level)), "grades")
    levels = graded.where("_level IS NOT NULL").groupBy("_key").agg(F.max_by("_level", "_grade").alias("_at"))
    p = F.least(F.lit(1.0), F.coalesce(F.col("_at") * F.col("_h"), F.lit(1.0)))
    return materialize(of_source(graded.drop("_level"), materialize(levels, "levels")).withColumn("_p", p).select("_key", "_grade", "_n", "_words", "_p"), "inclusion")


def of_source(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(checked_broadcast(right), "_key", "left")


def _cell() -> Column:
    return F.floor(F.col("_v") * _RANGES * _RANGES).cast("long")


def _cut(contested: DataFrame, start: DataFrame, amount: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Where the amounts (sizes) along each source's order cross its `_rest`, and the rows of that last range: those that
    still fit are taken."""
    amount = F.col("size") if amount is None else amount
    cell = _cell()
    cut = start.select("_key", "_rest", F.lit(0).cast("long").alias("_from"), F.lit(0.0).alias("_before"))
    for width in (_RANGES, 1):  # cells in a range of this level
        inside = contested if width == _RANGES else of_source(contested, cut.select("_key", "_from")).where(F.floor(cell / _RANGES) == F.col("_from")).drop("_from")
        sums = inside.groupBy("_key", F.floor(cell / width).cast("long").alias("_range")).agg(F.sum(amount).alias("_sum"))
        sums = sums.join(cut.select("_key", "_rest", "_before"), "_key")
        upto = F.sum("_sum").over(W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) + F.col("_before")
        crossing = sums.withColumn("_upto", upto).where(F.col("_upto") > F.col("_rest"))
        first = crossing.groupBy("_key", "_rest").agg(F.min(F.struct("_range", F.expr("_upto - _sum").alias("_before"))).alias("_c"))
        cut = materialize(first.select("_key", "_rest", F.col("_c._range").alias("_from"), F.col("_c._before").alias("_before")), "cut")
    last = of_source(contested, cut).where(cell == F.col("_from"))
    upto = F.sum(amount).over(W.partitionBy("_key").orderBy("_v", "doc_id", "size", "_row").rowsBetween(W.unboundedPreceding, 0)) + F.col("_before")
    return cut, materialize(last.withColumn("_fits", upto <= F.col("_rest")).select("_row", "_fits"), "last")


def _marked(rows: DataFrame, cut: DataFrame, last: DataFrame) -> DataFrame:
    """`rows` with _taken."""
    marked = of_source(rows, cut.select("_key", "_from")).join(checked_broadcast(last), "_row", "left")
    taken = F.when(F.col("_v").isNull(), F.lit(False)).when(F.col("_from").isNull(), F.lit(True)).otherwise((_cell() < F.col("_from")) | F.coalesce(F.col("_fits"), F.lit(False)))
    return marked.withColumn("_taken", taken).drop("_from", "_fits")


def _filled(left: DataFrame, gap: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows taken past the cut (_key, _row, _round), and for each source and round the last document and what it misses."""
    extra, ends, n = None, None, 0
    while True:
        # what is no nearer than nothing is no last document now or later, for the gap only falls
        left = materialize(of_source(left, gap).where(F.col("size") < 2 * F.col("_gap")), "left")
        near = left.groupBy("_key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_gap")).alias("m"), "_v", "doc_id", "_row")).alias("_f"))
        end = of_source(gap, materialize(near, "near")).select("_key", "_gap", F.coalesce("_f.m", "_gap").alias("_error"), F.lit(n).alias("_round"), F.col("_f._row").alias("_fill"))
        end = materialize(end, "end")
        ends = end if ends is None else ends.unionByName(end)
        short = of_source(end, targets).where("_error * 1000 > target").select("_key", F.col("_gap").alias("_rest"))
        short = materialize(short, "short")
        left = left.drop("_gap").join(checked_broadcast(short), "_key")
        fit = left.where("size <= _rest").drop("_rest")
        if fit.isEmpty():
            break
        more = materialize(_marked(fit, *_cut(fit, short)).where("_taken").select("_key", "_row", "size", F.lit(n).alias("_round")), "more")
        extra = more if extra is None else extra.unionByName(more)
        taken = materialize(more.groupBy("_key").agg(F.sum("size").alias("_more")), "taken")
        gap = materialize(of_source(short, taken).select("_key", (F.col("_rest") - F.coalesce("_more", F.lit(0))).alias("_gap")), "gap")
        left = left.drop("_rest").join(checked_broadcast(more.select("_row")), "_row", "left_anti")
        n += 1
    if extra is None:
        extra = ends.limit(0).select("_key", F.col("_fill").alias("_row"), "_round")
    return extra, ends


def _plan(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, seed: str = "mix", size_power: float = 0.5, tolerance: float = 0.004) -> DataFrame:
    rows = rows.withColumn("_grade", F.when(F.col("size") > 0, F.length(F.bin("size")) - 1))
    grades = materialize(rows.groupBy("source", "_grade").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words")), "grades")
    targets = source_targets(materialize(grades.groupBy("source").agg(F.sum("_words").alias("source_size")), "sizes"), weights, share, max_copies)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).otherwise(F.lit(0.0))
    whole = F.least(F.floor(due + F.lit(1e-12)), F.lit(max_copies)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    targets = targets.withColumn("_whole", whole).withColumn("_rest", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0)))
    targets = materialize(targets.withColumn("_key", key), "targets")
    chances = inclusion(grades.withColumn("_key", key).drop("source"), targets.select("_key", "_rest"), size_power)
    sure = F.col("_p") >= 1
    sums = chances.groupBy("_key").agg(F.sum(F.when(sure, F.col("_words")).otherwise(0)).alias("_sure"), F.round(F.sum(F.when(~sure, F.col("_p") * F.col("_n")).otherwise(0.0))).alias("_fixed"))
    start = of_source(targets.select("_key", "target", "_rest"), materialize(sums, "sums")).where("_rest > 0")
    start = materialize(start.select("_key", "target", (F.col("_rest") - F.col("_sure")).alias("_open"), "_fixed"), "start")

    u = uniform(F.col("doc_id"), seed)
    odds = (u / (F.lit(1.0) - u)) * ((F.lit(1.0) - F.col("_p")) / F.col("_p"))
    # v is the quotient brought into (0, 1); what is certain, or has nothing left to draw, needs none
    v = F.when((F.col("_p") > 0) & (F.col("_p") < 1), odds / (F.lit(1.0) + odds))
    keyed = rows.withColumn("_key", key).drop("source").join(checked_broadcast(chances.select("_key", "_grade", "_p")), ["_key", "_grade"], "left")
    drawn = materialize(keyed.withColumn("_p", F.coalesce("_p", F.lit(0.0))).withColumn("_v", v).drop("_grade"), "drawn")

    # the sample of fixed size
    contested = drawn.where(F.col("_v").isNotNull())
    marked = _marked(drawn, *_cut(contested, start.select("_key", F.col("_fixed").alias("_rest")), F.lit(1)))
    marked = materialize(marked.withColumnRenamed("_taken", "drawn"), "sample")
    words = materialize(marked.where("drawn").groupBy("_key").agg(F.sum("size").alias("_got")), "words")
    missing = F.abs(F.col("_open") - F.coalesce("_got", F.lit(0)))
    off = materialize(of_source(start, words).where(missing > F.lit(tolerance) * F.col("target")).select("_key", F.col("_open").alias("_rest"), F.lit(True).alias("_off")), "off")

    # sources whose sample misses the words: the end is moved along the order
    moved = of_source(marked, off.select("_key", "_off"))
    cut, last = _cut(moved.where("_off AND _v IS NOT NULL"), off.select("_key", "_rest"))
    moved = _marked(moved, cut, last)
    marked = moved.withColumn("_taken", (F.col("_p") >= 1) | F.when(F.col("_off"), F.col("_taken")).otherwise(F.col("drawn")))
    marked = materialize(marked, "marked")
    inside = marked.where("_off AND _v IS NOT NULL")
    taken = inside.where("_taken").groupBy("_key").agg(F.sum("size").alias("_more"))
    gap = of_source(cut.select("_key", "_rest"), materialize(taken, "gap")).select("_key", (F.col("_rest") - F.coalesce("_more", F.lit(0))).alias("_gap"))
    left = inside.where(~F.col("_taken") & (F.col("size") > 0)).select("_key", "_row", "_v", "doc_id", "size")
    extra, ends = _filled(left, materialize(gap, "gap"), targets.select("_key", "target"))

    best = ends.groupBy("_key").agg(F.min(F.struct("_error", "_round", "_fill")).alias("_b")).select("_key", "_b._round", "_b._fill")
    best = materialize(best, "best")
    also = of_source(extra, best.select("_key", F.col("_round").alias("_end"))).where("_round < _end").select("_row")
    also = materialize(also.unionByName(best.where("_fill IS NOT NULL").select(F.col("_fill").alias("_row"))).withColumn("_also", F.lit(True)), "also")
    marked = marked.join(checked_broadcast(also), "_row", "left")
    marked = of_source(marked, targets.select("_key", "source", "source_size", "target", "_whole"))
    copies = F.col("_whole") + (F.col("_taken") | F.coalesce("_also", F.lit(False))).cast("long")
    out = marked.withColumn("copies", F.least(copies, F.lit(max_copies).cast("long")))
    return materialize(out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.col("_p").alias("p"), (F.col("drawn") | (F.col("_p") >= 1)).alias("drawn"), "_row"), "mix")


def mix_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of `df`, each as often as the mix takes it. Options as of `mix_plan`."""
    numbered = materialize(df.withColumn("__mix_row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.col("__mix_row").alias("_row"))
    plan = _plan(materialize(rows, "sizes"), **options)
    due = materialize(plan.where("copies > 0").select(F.col("_row").alias("__mix_row"), F.col("copies").alias("__mix_copies")), "copies")
    out = numbered.join(checked_broadcast(due), "__mix_row")
    return out.withColumn("__mix_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*df.columns)
