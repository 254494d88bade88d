"""Quality rules as a short-circuit cascade.

The measures that the base rules need are taken of every text in one pass. The other rules are a CASE whose branches
Spark evaluates only until one rejects. Their order is chosen on a bounded sample (`sample_rows` documents drawn by a hash
of their text and id): which rules each sampled document breaks comes from one aggregate, what a rule costs is the CPU time
of tasks that evaluate it alone, to the nearest power of two. The first rule is the one of most rejections per cost among
documents that pass the base, the next the one of most among those that the first leaves, and so on; ties go by name. The
verdict is a conjunction, so the order changes the work and never the result.

All of it is SQL expressions inside one projection: no shuffle, so no key can be hot and memory is bounded by a text.
A word is counted as repeated if it lies in a window of three words that occurs at least twice; the windows of a text are
sorted with their positions and neighbours compared, so a long text costs n log n.

Defined results: a null or blank text has no words and fails the base rule; repeated rows are judged alike; an empty table
gives no rows; the columns added replace any of the same name.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.plans.shared import materialize

from .common import fresh, hash_below

_BLANK = r"\\x20\\x09-\\x0D"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
ADDED = (*MEASURES, "base_failed", "failed_rule", "kept")


@dataclass(frozen=True)
class Rule:
    """`fails` is a SQL condition over the measures and `text` (never null there)."""

    name: str
    fails: str


#: Base rules, of the contract; a document that fails one is out whatever the cascade says.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

RULES = (
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", "2 * length(regexp_replace(text, '[^\\\\p{Lu}]', '')) > length(regexp_replace(text, '[^\\\\p{L}]', ''))"),
    Rule("exclamation", "4 * (length(text) - length(translate(text, '!', ''))) > n_words"),
    Rule("wordless", "2 * regexp_count(text, '\\\\p{L}[^\\\\s]*') < n_words"),
)


def _let(name: str, value: str, body: str) -> str:
    """SQL: `body` with `name` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def measures_sql(text: str) -> str:
    """SQL struct of MEASURES; `text` is a SQL expression that is never null."""
    windows = "transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> concat_ws(' ', x, w[i + 1], w[i + 2]))"
    placed = "array_sort(transform(g, (x, i) -> struct(x AS g, i AS i)))"
    twice = "filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].g = x.g) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].g = x.g))"
    covered = "aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> coalesce(least(b - a, 3), 3)), 0, (n, x) -> n + x)"
    # equal windows have equal hashes, so only texts with equal hashes need their windows as text
    hashes = "transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))"
    exact = _let("g", windows, _let("s", placed, _let("p", f"array_sort(transform({twice}, x -> x.i))", covered)))
    repeats = _let("h", hashes, f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {exact} END")
    lines = f"filter(split(t, '\\n', -1), l -> l RLIKE '[^{_BLANK}]')"
    line_counts = _let("l", lines, "struct(size(l) AS n, size(l) - size(array_distinct(l)) AS dup)")
    body = _let("w", f"regexp_extract_all(t, '[^{_BLANK}]+', 0)", f"struct(size(w) AS n, length(array_join(w, '')) AS chars, {repeats} AS rep)")
    out = f"named_struct('n_words', bigint(c.n), 'word_chars', bigint(c.chars), 'n_symbols', bigint(length(t) - length(translate(t, '#*$%&|<>', ''))), 'n_lines', bigint(d.n), 'n_dup_lines', bigint(d.dup), 'n_repeat_words', bigint(c.rep))"
    return _let("t", text, _let("c", body, _let("d", line_counts, out)))


def with_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    held = fresh(df.columns, "_m")
    return df.withColumn(held, F.expr(measures_sql(f"coalesce(`{text_col}`, '')"))).withColumns({m: F.col(f"`{held}`.{m}") for m in MEASURES}).drop(held)


def cascade_order(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, repeats: int = 2) -> list[Rule]:
    """The rules by falling rejections per cost on a sample of about `sample_rows` documents."""
    rows = df.count()
    if not rows:
        return list(rules)
    drawn = hash_below(F.struct(id_col, text_col), sample_rows / rows)
    sample = df.where(drawn).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = materialize(with_measures(sample, "text"), "sample")

    broken = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(rules))
    found = sample.where(f"NOT ({BASE_FAILED})").groupBy(F.expr(broken).alias("broken")).agg(F.count(F.lit(1)).alias("n")).collect()
    left = {r["broken"]: r["n"] for r in found}
    idle = _cpu_seconds(sample, "n_words < 0", repeats)
    cost = [2.0 ** round(math.log2(max(_cpu_seconds(sample, r.fails, repeats) - idle, 1e-4))) for r in rules]
    order: list[Rule] = []
    while len(order) < len(rules):
        rejected = [sum(n for b, n in left.items() if b >> i & 1) for i in range(len(rules))]
        i = min((i for i, r in enumerate(rules) if r not in order), key=lambda i: (-rejected[i] / cost[i], rules[i].name))
        order.append(rules[i])
        left = {b: n for b, n in left.items() if not b >> i & 1}
    return order


def _cpu_seconds(sample: DataFrame, condition: str, repeats: int) -> float:
    """Least CPU time, over `repeats` jobs, that tasks took to evaluate a condition on all of `sample`."""
    context = sample.sparkSession.sparkContext
    best = math.inf
    for _ in range(repeats):
        group = f"cost-{uuid.uuid4().hex}"
        context.setLocalProperty("spark.jobGroup.id", group)
        try:
            sample.agg(F.sum(F.expr(f"CAST({condition} AS INT)"))).first()
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
        best = min(best, sum(store.lastStageAttempt(s).executorCpuTime() for s in stages) / 1e9)
    return best


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """`df` with MEASURES, base_failed, failed_rule (null: none; the first in the cascade's order) and kept."""
    order = cascade_order(df, rules, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    cases = " ".join(f"WHEN {r.fails} THEN '{r.name}'" for r in order)
    if text_col != "text":  # the rules say `text`: the row stands beside it while they are judged
        row = df.drop(*ADDED).select(F.struct("*").alias("__row"), F.col(f"`{text_col}`").alias("text"))
        judged = judge_in_order(row, cases)
        return judged.select("__row.*", *ADDED)
    return judge_in_order(df, cases)


def judge_in_order(df: DataFrame, cases: str) -> DataFrame:
    measured = with_measures(df).withColumn("base_failed", F.expr(BASE_FAILED))
    return measured.withColumn("failed_rule", F.expr(f"CASE WHEN base_failed THEN 'base' {cases} END")).withColumn("kept", F.col("failed_rule").isNull())
