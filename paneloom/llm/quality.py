"""Quality classification with hierarchical empirical Bayes.

Evidence of a document: a logistic regression over the shape of its text (shares of letters, capitals, digits, symbols,
punctuation; entropy of its bytes; distinct words and lines; lengths), fitted on at most `max_labelled` labelled documents
(the lowest by a hash of their id), which is the only bounded sample here.

Hosts and paths: the evidence of all documents is summed by host and by path (partial sums before the shuffle, so a hot
host is one row for each task). A host's posterior mean is shrunk towards the global mean and a path's towards its
host's, each with a Beta precision estimated by moments over all hosts or paths, so sparse sites say little. A document's
posterior odds are its own evidence with the global prior odds replaced by those of its path, in which its own evidence is
left out, so it counts once.

`documents` has no URL, so its host is `source` and its path `lang`; any two columns, or expressions of a URL, will do.

Defined results: a null text is the empty text; null hosts and paths are groups of their own; repeated rows count as often
as they occur; of several labels of one id the lowest counts; with labels of one class only (or none) the evidence is that class's smoothed rate; an empty table gives no
rows; other columns of the table are kept by `with_quality` and replaced only where the names are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.plans.shared import checked_broadcast, materialize

from .common import bounded_batches, fresh, leave_cache, released

N_FEATURES = 16
#: p_quality from which a document is kept.
THRESHOLD = 0.5
ADDED = ("p_doc", "host_posterior", "path_posterior", "p_quality")


def features(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    n = max(1, len(data))
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, high = h[65:91].sum(), h[97:123].sum(), h[128:].sum()
    p = h[h > 0] / n
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n_w, n_l = max(1, len(words)), max(1, len(lines))
    return [
        1.0,
        np.log(n),
        upper / max(1, upper + lower),
        h[48:58].sum() / n,
        sum(int(h[ord(c)]) for c in "#*$%&<>@^~") / n_w,
        h[ord("|")] / n_w,
        h[ord("!")] / n_w,
        h[ord(".")] / n_w,
        h[ord(",")] / n_w,
        high / n,
        (h[58:65].sum() + h[91:97].sum() + h[123:127].sum()) / n_w,
        float(-(p * np.log(p)).sum()),
        len(set(words)) / n_w,
        len(set(lines)) / n_l,
        min(5.0, len(data) / n_w / 6),
        min(5.0, n_w / n_l / 20),
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leave_cache()
    for b in released(batches):
        rows = [features(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.float64()), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])


def _scored(batches: Iterator[pa.RecordBatch], text_at: int, model: tuple, names: list[str]) -> Iterator[pa.RecordBatch]:
    leave_cache()
    mean, scale, w = model
    for b in released(batches):
        x = np.array([features(t or "") for t in b.column(text_at).to_pylist()]).reshape(-1, N_FEATURES)
        z = np.clip(((x - mean) / scale) @ w, -12, 12)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)))], names=names)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, ridge: float = 1.0) -> tuple:
    """mean, scale and weights of a logistic regression; the sample's features (16 numbers a row) meet on the driver."""
    chosen = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).groupBy("_id").agg(F.min("y").alias("y"))
    chosen = materialize(chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled), "labelled")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    got = rows.select("y", "text").mapInArrow(_featured, "y double, x array<double>").toPandas()
    if not len(got):
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES)
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # partitions arrive in any order; sums must not depend on it
    x, y = x[order], y[order]
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale < 1e-9] = 0.0, 1.0
    scale[0] = 1.0
    z = (x - mean) / scale
    w = np.zeros(N_FEATURES)
    w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    penalty = np.full(N_FEATURES, ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def with_evidence(docs: DataFrame, model: tuple, *, text_col: str = "text") -> DataFrame:
    """`docs` and p_doc."""
    base = docs.drop("p_doc")
    schema = T.StructType([*base.schema.fields, T.StructField("p_doc", T.DoubleType())])
    return base.mapInArrow(partial(_scored, text_at=base.columns.index(text_col), model=model, names=[*base.columns, "p_doc"]), schema)


def _precision(groups: DataFrame, mean: Column) -> float:
    """Beta precision by moments: how far group means spread beyond what their sizes explain."""
    p, n = F.col("_sum") / F.col("_n"), F.col("_n")
    got = groups.where(n > 1).agg(F.sum(n), F.sum(n * (p - mean) ** 2), F.sum(n * mean * (1 - mean)), F.count(F.lit(1))).first()
    if not got[0] or got[3] < 2:
        return 100.0
    total, spread, within, k = got
    noise = within / total
    between = max(1e-9, (spread - k * noise) / max(1.0, total))
    return float(min(1e6, max(1.0, noise / between - 1)))


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """_host, _path, p_doc -> a row for each path with its host's and its own posterior; and the global mean."""
    paths = materialize(evidence.groupBy("_host", "_path").agg(F.sum("p_doc").alias("_sum"), F.count(F.lit(1)).alias("_n")), "paths")
    total, n = paths.agg(F.sum("_sum"), F.sum("_n")).first()
    prior = (total + 0.5) / (n + 1) if n else 0.5
    hosts = materialize(paths.groupBy("_host").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n")), "hosts")
    k = _precision(hosts, F.lit(prior))
    hosts = hosts.select(F.col("_host").alias("_h"), ((F.col("_sum") + F.lit(k * prior)) / (F.col("_n") + F.lit(k))).alias("host_posterior"))
    joined = materialize(paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h"), "shrunk")
    k = _precision(joined, F.col("host_posterior"))
    own = (F.col("_sum") + F.lit(k) * F.col("host_posterior")) / (F.col("_n") + F.lit(k))
    return materialize(joined.select("_host", "_path", "_n", F.lit(k).alias("_k"), "host_posterior", own.alias("path_posterior")), "posteriors"), prior


def without_own(posterior: Column, n: Column, k: Column, p: Column) -> Column:
    """A path's posterior from its n documents and precision k, without the evidence p of one of them."""
    return F.greatest(posterior * (n + k) - p, F.lit(0.0)) / (n - 1 + k)


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (F.lit(1.0) - p))


def with_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column = "lang", label_col: str = "quality", max_labelled: int = 20_000, site_weight: float = 1.0) -> DataFrame:
    """`docs` and p_doc, host_posterior, path_posterior, p_quality."""
    bounded_batches(docs.sparkSession)
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_labelled=max_labelled)
    narrow = docs.select(host.cast("string").alias("_host"), path.cast("string").alias("_path"), F.col(text_col).alias("text"))
    sites, prior = posteriors(with_evidence(narrow, model).select("_host", "_path", "p_doc"))
    own = {c: fresh(docs.columns, f"_{c}") for c in ("_host", "_path", "_n", "_k")}
    sites = checked_broadcast(sites.withColumnsRenamed(own))
    rows = with_evidence(docs.drop(*ADDED), model, text_col=text_col)
    rows = rows.join(sites, host.cast("string").eqNullSafe(F.col(own["_host"])) & path.cast("string").eqNullSafe(F.col(own["_path"])), "left")
    others = without_own(F.col("path_posterior"), F.col(own["_n"]), F.col(own["_k"]), F.col("p_doc"))
    z = _odds(F.col("p_doc")) + F.lit(site_weight) * (_odds(others) - _odds(F.lit(prior)))
    return rows.withColumn("p_quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop(*own.values())
