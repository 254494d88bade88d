"""Incremental statistics on streams: additive sums are the state, and statistics are finished in a projection.

Rows of missing value or weight, or weight <= 0, are dropped before the stateful step. Squares are summed around a fixed
shift, so variances do not cancel.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions.missing import known, valid
from paneloom.operators.sweep import Fit, added, shifted_sums, solved, statistics
from paneloom.plans.shared import shared_folder, written_later


def sums(x: str | Column, w: str | Column | None = None, shift: float = 0.0) -> list[Column]:
    v = known(x) - F.lit(float(shift))
    u = F.lit(1.0) if w is None else known(w)
    return [F.count(F.lit(1)).alias("count"), F.sum(u).alias("_w"), F.sum(u * u).alias("_w2"), F.sum(u * v).alias("_x"), F.sum(u * v * v).alias("_x2"), F.min(known(x)).alias("min"), F.max(known(x)).alias("max")]


def finish(df: DataFrame, shift: float = 0.0) -> DataFrame:
    mean = F.col("_x") / F.col("_w")
    variance = F.when(F.col("count") > 1, F.greatest(F.col("_x2") / F.col("_w") - mean * mean, F.lit(0.0)))
    d_count = F.col("_w") * F.col("_w") / F.col("_w2")
    out = df.withColumns({"d_count": d_count, "mean_wt": F.col("_w") / F.col("count"), "mean": mean + F.lit(float(shift)), "variance": variance, "std_dev": F.sqrt(variance), "std_err": F.sqrt(variance / d_count)})
    return out.drop("_w", "_w2", "_x", "_x2")


def incremental_moments(stream: DataFrame, x: str, w: str | None = None, by: Sequence[str | Column] = (), shift: float = 0.0) -> DataFrame:
    return finish(stream.where(valid(x, w)).groupBy(*by).agg(*sums(x, w, shift)), shift)


def windowed_moments(stream: DataFrame, time: str, size: str, x: str, *, slide: str | None = None, watermark: str | None = None, by: Sequence[str] = (), w: str | None = None, shift: float = 0.0) -> DataFrame:
    """Tumbling or sliding event-time windows: window_start, by, statistics."""
    base = stream.withColumn(time, F.col(time).cast("timestamp"))
    base = base.withWatermark(time, watermark) if watermark else base
    span = F.window(time, size, slide) if slide else F.window(time, size)
    got = incremental_moments(base, x, w, [span, *by], shift)
    return got.withColumn("window_start", F.col("window.start")).drop("window")


def session_moments(stream: DataFrame, time: str, gap: str, x: str, *, by: Sequence[str], watermark: str | None = None, shift: float = 0.0) -> DataFrame:
    base = stream.withColumn(time, F.col(time).cast("timestamp"))
    base = base.withWatermark(time, watermark) if watermark else base
    got = incremental_moments(base, x, None, [F.session_window(time, gap), *by], shift)
    return got.withColumns({"session_start": F.col("session_window.start"), "session_end": F.col("session_window.end")}).drop("session_window")


def regression_sums(stream: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Streaming fit of one predictor: count, slope, intercept from additive sums. For several predictors, weights, or values
    far from 0 see `grow_regression`."""
    a, b = known(x), known(y)
    s = stream.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.sum(a).alias("_a"), F.sum(b).alias("_b"), F.sum(a * a).alias("_aa"), F.sum(a * b).alias("_ab"))
    n = F.col("count")
    slope = F.try_divide(F.col("_ab") - F.col("_a") * F.col("_b") / n, F.col("_aa") - F.col("_a") * F.col("_a") / n)
    return s.withColumn("slope", slope).withColumn("intercept", (F.col("_b") - F.col("slope") * F.col("_a")) / n).drop("_a", "_b", "_aa", "_ab")


class _Versions:
    """A table that micro-batches replace, in the shared folder. A version is named by its batch, so that a batch which a stream
    gives again after a failure replaces what it had left; of older versions the last two stay."""

    def __init__(self, spark: SparkSession, name: str):
        self.folder = f"{shared_folder(spark)}/{name}"
        self.spark = spark
        written_later(spark, self.folder)

    def _path(self, batch: int):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{batch:012d}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def before(self, batch: int) -> DataFrame | None:
        """The newest whole version of an earlier batch."""
        path, system = self._path(batch)
        if not system.exists(path.getParent()):
            return None
        names = sorted(f.getPath().getName() for f in system.listStatus(path.getParent()))
        done = [n for n in names if n < path.getName() and system.exists(self._path(int(n))[0].suffix("/_SUCCESS"))]
        return self.spark.read.parquet(f"{self.folder}/{done[-1]}") if done else None

    def put(self, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{batch:012d}")
        old, system = self._path(batch - 3)
        system.delete(old, True)


def grow_regression(stream: DataFrame, fits: Sequence[Fit], weight: str | None = None, by: Sequence[str] = (), *, constant: bool = True, checkpoint: str | None = None) -> DataFrame:
    """Weighted fits of several predictors on all that a stream has now: by, label, size, count, d_count, mean_wt, names and
    coefficients.

    Each micro-batch is summed by partial aggregates, a hot key like any other, around each key's own means of the batch; the
    state, one row of moments for each key, is moved to common means and added to. So no sum is of large numbers that
    cancel, and state and work for a batch are those of its keys and of the matrix.
    """
    spark: SparkSession = stream.sparkSession
    name = f"regression_{uuid.uuid4().hex}"
    state = _Versions(spark, name)
    variables = list(dict.fromkeys(v for f in fits for v in (*f.predictors, f.response)))

    def take(batch: DataFrame, number: int) -> None:
        new = shifted_sums(batch, variables, weight, by)
        old = state.before(number)
        state.put(number, new if old is None else added(old.unionByName(new), len(variables), by))

    folder = checkpoint or f"{state.folder}-state"
    written_later(spark, folder)
    stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", folder).foreachBatch(take).start().awaitTermination()
    sums = state.before(1 << 62)
    if sums is None:
        sums = shifted_sums(spark.createDataFrame([], stream.schema), variables, weight, by)
    got = statistics(solved(sums, fits, by, constant=constant), fits, None, weight, by, constant=constant)
    return got.select(*by, "label", "size", "count", "d_count", "mean_wt", "names", "coefficients")


def first_of_key(stream: DataFrame, keys: Sequence[str], time: str, watermark: str) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))


def quantile_sketches(stream: DataFrame, x: str, by: Sequence[str] = (), k: int = 200) -> DataFrame:
    """Quantiles on an unbounded stream from a mergeable sketch of bounded size (the exact form would keep every value): by,
    count, sketch. A larger `k` makes the ranks finer, about 1.3 % at 200 and a quarter of that at 800."""
    return stream.where(known(x).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.kll_sketch_agg_double(known(x), F.lit(k)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """The quantiles that sketches hold, as an array in the order given."""
    held = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(q)) for q in quantiles]))
    return sketches.withColumn("quantiles", held).drop("sketch")


def value_counts(stream: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """The exact state of incremental quantiles: each value and how often it came, a row of state for each (see
    `quantiles.quantiles_of_counts`)."""
    return stream.where(known(x).isNotNull()).groupBy(*by, known(x).alias(x)).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, mode: str = "complete", *, path: str | None = None) -> DataFrame:
    """All that is available now, as a batch table: Parquet in the shared folder, or for appended rows in `path`. `shared.clear`
    and the end of the driver delete it with the stream's state."""
    spark: SparkSession = stream.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    written_later(spark, folder)
    written_later(spark, f"{folder}-state")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}-state")
    if path or mode == "append":
        query = writer.format("parquet").option("path", path or folder).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path or folder)
    # complete results are rewritten as a table by each batch: the last one stands
    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], mode: str = "complete"):
    return stream.writeStream.outputMode(mode).trigger(availableNow=True).foreachBatch(act).start()
