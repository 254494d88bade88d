"""Nearest neighbours by an index of cells, exactly, with full statistics of their distances and responses.

Centers of cells are fitted on a bounded sample (`SAMPLE_BYTES` of features; at most `MOST_CELLS` centers within
`CENTER_BYTES`); every row is put in the cell of its nearest center. A cell's rows are packed in order of their distance
from it in blocks of at most `BLOCK_ROWS`, so that a block is a shell and a cell of any size is many blocks. By the triangle
inequality no row of a shell [low, high] is nearer to a query than max(D - high, low - D), with D the query's
distance from the center.

A search first looks through each query's nearest cells until these hold enough rows. The k-th distance found there bounds
the second look: at all other cells, and of these the shells, that can hold something as near. What a cell is asked is
packed too, and packs of queries meet blocks of rows in a join on the cell. So nothing is approximate, and how much is skipped
depends on how well the rows fall into cells; a task keeps k rows for each query.

Where bounds leave many cells for each query (vectors that are no clouds), the second look writes no query once for each
cell. Queries lie in blocks, in order of their cells, and these meet the blocks of rows in a product of parts, of which
pairs are taken where a query of the block can find something. What is shuffled is then each side once and k rows for
each query and part of the rows.

Distances are Minkowski's after features are scaled by their share of the weights. For powers below 1, which have no triangle
inequality, all cells are looked at. Rows with missing features are nobody's neighbours and have none. Ids are integers
and unique; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneloom.functions.missing import known
from paneloom.functions.scalars import reciprocal_weights
from paneloom.plans.shared import materialize

from .quantiles import PERCENTILES, percentile_name
from .stats import full_summary

SAMPLE_BYTES, CENTER_BYTES, MOST_CELLS, BLOCK_ROWS = 4 << 20, 2 << 20, 4096, 2048
#: Most rows of a batch of queries for which distances to all centers, or to a block, are held.
_QUERY_ROWS = 1024
#: Cells left for each query, on average, beyond which blocks of queries and of rows meet in a product.
_SHUFFLED_CELLS = 4
#: Bytes of features in a part of the rows of that product, and distances that a task computes, at about the most.
_PART_BYTES, _TASK_PAIRS = 32 << 20, 1 << 30
#: What rounding may add to a bound, as a share of it.
_SLACK = 1e-9
_FOUND = "i long, j long, d double"


def _distances(x: np.ndarray, y: np.ndarray, power: float) -> np.ndarray:
    """Distances of all rows of x from all of y, feature by feature."""
    out = np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        step = np.abs(x[:, f, None] - y[:, f])
        out += step * step if power == 2 else step**power
    return np.sqrt(out) if power == 2 else out ** (1.0 / power)


def _closest(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, k: int, power: float, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, d) of the k nearest rows of y for each of x, no further than its bound and not itself. With power 2 what
    is near comes from a matrix product, with a margin above its rounding, and its distances are then summed exactly."""
    if power == 2:
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        near = xx[:, None] + yy - 2 * (x @ y.T)
        margin = 8 * np.finfo(float).eps * (x.shape[1] + 8) * (xx + yy.max())
        limit = bound * bound
    else:
        near, margin, limit = _distances(x, y, power), np.zeros(len(x)), bound
    near[i[:, None] == j] = np.inf
    kth = np.partition(near, k - 1, axis=1)[:, k - 1] if k < len(j) else np.full(len(i), np.inf)
    a, c = np.nonzero((near <= (np.minimum(kth, limit) * (1 + _SLACK) + margin)[:, None]) & (near < np.inf))
    d = np.zeros(len(a))
    for f in range(x.shape[1]):
        step = np.abs(x[a, f] - y[c, f])
        d += step * step if power == 2 else step**power
    d = np.sqrt(d) if power == 2 else d ** (1.0 / power)
    order = np.lexsort((j[c], d, a))
    a, c, d = a[order], c[order], d[order]
    first = np.searchsorted(a, np.arange(len(i)))
    keep = np.arange(len(a)) - first[a] < k
    return i[a[keep]], j[c[keep]], d[keep]


def _within(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, k: int, power: float, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places a, c in x and y of pairs no further apart than the bound of x, and their distances. Where these are many, of each
    x only those that can be among its k nearest."""
    if power == 2:
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        near = x @ (-2 * y.T)
        near += yy
        limit = bound * bound * (1 + _SLACK) + 8 * np.finfo(float).eps * (x.shape[1] + 8) * (xx + yy.max()) - xx
    else:
        near, limit = _distances(x, y, power), bound * (1 + _SLACK)
    a, c = np.nonzero(near <= limit[:, None])
    if len(a) > 8 * (k + 1) * len(i) and k + 1 < len(j):
        # a row may be itself among its k + 1 nearest
        kth = np.partition(near, k, axis=1)[:, k]
        spare = 16 * np.finfo(float).eps * (x.shape[1] + 8) * (xx + yy.max()) if power == 2 else _SLACK * kth
        a, c = np.nonzero(near <= np.minimum(limit, kth + spare)[:, None])
    other = i[a] != j[c]
    a, c = a[other], c[other]
    d = np.zeros(len(a))
    for f in range(x.shape[1]):
        step = np.abs(x[a, f] - y[c, f])
        d += step * step if power == 2 else step**power
    d = np.sqrt(d) if power == 2 else d ** (1.0 / power)
    keep = d <= bound[a]
    return a[keep], c[keep], d[keep]


def fit_centers(sample: np.ndarray, cells: int, power: float, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centers by a few rounds of k-means; a cell left empty keeps its center."""
    r = np.random.default_rng(seed)
    centers = sample[r.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_cells(sample[a : a + 4096], centers, power)[0] for a in range(0, len(sample), 4096)])
        n = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def _cells(x: np.ndarray, centers: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row and the exact distance from it. Any center would be right; the nearest prunes best."""
    rough = ((x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1) - 2 * (x @ centers.T)) if power == 2 else _distances(x, centers, power)
    own = rough.argmin(axis=1)
    step = np.abs(x - centers[own])
    return own, (step**power).sum(axis=1) ** (1.0 / power)


def _features(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


@dataclass(frozen=True)
class CellIndex:
    """`blocks`: cell, ids, x (packed), n, low, high; `cells`: rows, low and high of every cell."""

    blocks: DataFrame
    centers: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    power: float
    scale: np.ndarray | None


def _scaled(df: DataFrame, id_col: str, features: str) -> DataFrame:
    whole = df.where(F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull() | F.isnan(x)))
    return whole.select(F.col(id_col).cast("long").alias("i"), F.col(features).cast("array<double>").alias("x"))


def build_index(df: DataFrame, id_col: str, features: str, *, power: float = 2.0, weights: Sequence[float] | None = None, cells: int | None = None, block_rows: int = BLOCK_ROWS) -> CellIndex:
    """The index of all rows. `cells`: about the root of the number of rows by default."""
    spark = df.sparkSession
    scale = None if weights is None else np.array(weights, float) / float(sum(weights))
    whole = _scaled(df, id_col, features)
    n, width = whole.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    width = width or 1
    if not n:
        none = spark.createDataFrame([], "cell int, ids binary, x binary, n int, low double, high double")
        return CellIndex(none, np.zeros((1, width)), np.zeros(1), np.zeros(1), np.zeros(1), power, scale)
    wanted = max(1, min(n, SAMPLE_BYTES // (8 * width)))
    # twice the share is drawn by a hash of the id, of which the first by that hash are taken; they come packed as bytes
    low = int(-(2**63) + min(1.0, 2 * wanted / n) * (2**64 - 1))
    drawn = whole.select(F.xxhash64("i").alias("h"), "i", "x").where(F.col("h") <= F.lit(min(low, 2**63 - 1)))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = (b.column("h").to_numpy(), b.column("i").to_numpy(), _features(b.column("x")))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["h", "i", "x"])

    packs = drawn.mapInArrow(as_bytes, "h binary, i binary, x binary").collect()
    hashes, ids = (np.concatenate([np.frombuffer(r[c], np.int64) for r in packs]) for c in ("h", "i"))
    sample = np.concatenate([np.frombuffer(r["x"], np.float64).reshape(-1, width) for r in packs])[np.lexsort((ids, hashes))[:wanted]]
    del packs
    sample = sample if scale is None else sample * scale
    cells = max(1, min(cells or int(np.ceil(np.sqrt(n))), MOST_CELLS, CENTER_BYTES // (8 * width), max(1, len(sample) // 4)))
    centers = fit_centers(sample, cells, power)
    sent = spark.sparkContext.broadcast((centers, scale))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, factor = sent.value
        for b in batches:
            for at in range(0, len(b), 4096):
                some = b.slice(at, 4096)
                x = _features(some.column("x"))
                own, d = _cells(x if factor is None else x * factor, middle, power)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(d), some.column("i"), some.column("x")], ["cell", "d", "i", "x"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a cell's rows, which come in order of cell and distance."""
        _, factor = sent.value
        held: list[tuple] = []  # (cell, d, ids, x)

        def block() -> pa.RecordBatch:
            d, ids, x = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            row = [(held[0][0], pa.int32()), (ids.tobytes(), pa.binary()), (x.tobytes(), pa.binary()), (len(ids), pa.int32()), (float(d.min()), pa.float64()), (float(d.max()), pa.float64())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], ["cell", "ids", "x", "n", "low", "high"])

        for b in batches:
            if not len(b):
                continue
            cell, d, ids = (b.column(c).to_numpy() for c in ("cell", "d", "i"))
            x = _features(b.column("x"))
            x = x if factor is None else x * factor
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(b)]
            for s, e in zip(edges, edges[1:], strict=False):
                while s < e:
                    if held and held[0][0] != int(cell[s]):
                        yield block()
                    stop = min(e, s + block_rows - sum(len(h[1]) for h in held))
                    held.append((int(cell[s]), d[s:stop], ids[s:stop], x[s:stop]))
                    s = stop
                    if sum(len(h[1]) for h in held) == block_rows:
                        yield block()
        if held:
            yield block()

    placed = materialize(whole.mapInArrow(assigned, "cell int, d double, i long, x array<double>"), "assigned")
    blocks = placed.repartitionByRange("cell", "d", "i").sortWithinPartitions("cell", "d", "i").mapInArrow(packed, "cell int, ids binary, x binary, n int, low double, high double")
    blocks = materialize(blocks, "cells")
    rows, low, high = np.zeros(cells), np.full(cells, np.inf), np.full(cells, -np.inf)
    for r in blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():  # a row for each cell
        rows[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    return CellIndex(blocks, centers, rows, low, high, power, scale)


def _look(index: CellIndex, asked: DataFrame, k: int) -> DataFrame:
    """i, j, d: for each task the k nearest rows of each query among the blocks of the cells asked. `asked`: cell, ids, x, bound,
    away, all packed."""
    power = index.power

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            items = list(best.items())
            for at in range(0, len(items), 1000):
                some = items[at : at + 1000]
                i = np.repeat([q for q, _ in some], [len(v[0]) for _, v in some])
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(np.concatenate([v[0] for _, v in some])), pa.array(np.concatenate([v[1] for _, v in some]))], ["i", "j", "d"])

        for b in batches:
            for r in range(len(b)):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                ids, j = (np.frombuffer(row[c], np.int64) for c in ("ids", "row_ids"))
                bound, away = (np.frombuffer(row[c], np.float64) for c in ("bound", "away"))
                x, y = (np.frombuffer(row[c], np.float64).reshape(len(n), -1) for c, n in (("x", ids), ("row_x", j)))
                nearest_possible = np.maximum(away - row["high"], row["low"] - away) if power >= 1 else np.zeros(len(ids))
                here = nearest_possible <= bound * (1 + _SLACK) + _SLACK * (away + row["high"])
                if not here.any():
                    continue
                i, near, d = _closest(ids[here], x[here], j, y, k, power, bound[here])
                if not len(i):
                    continue
                edges = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                for s, e in zip(edges, [*edges[1:], len(i)], strict=True):
                    q = int(i[s])
                    if q in best:
                        n, m = np.append(best[q][0], near[s:e]), np.append(best[q][1], d[s:e])
                        order = np.lexsort((n, m))[:k]
                        best[q] = n[order], m[order]
                    else:
                        best[q] = near[s:e], d[s:e]
                        held += k
                if held > 2_000_000:
                    yield from emit()
                    best.clear()
                    held = 0
        yield from emit()

    # neither side may be broadcast: what is asked is taken for as small as the queries, but holds each once for every cell
    rows = index.blocks.select("cell", F.col("ids").alias("row_ids"), F.col("x").alias("row_x"), "low", "high").hint("merge")
    return asked.join(rows, "cell").drop("cell").mapInArrow(search, _FOUND)


def _asked(index: CellIndex, queries: DataFrame, k: int, first: bool) -> DataFrame:
    """Packs of queries for each cell to be looked at: the nearest ones that hold more than k rows, or then those of the
    others that the column `bound` leaves."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centers, index.rows, index.low, index.high, index.scale))
    power = index.power
    names = ["cell", "ids", "x", "bound", "away"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, rows, low, high, scale = sent.value
        for b in batches if rows.any() else ():
            for at in range(0, len(b), _QUERY_ROWS):
                some = b.slice(at, _QUERY_ROWS)
                ids = some.column("i").to_numpy()
                x = _features(some.column("x"))
                x = x if scale is None else x * scale
                away = _distances(x, centers, power)
                order = np.argsort(np.where(rows > 0, away, np.inf), axis=1, kind="stable")
                # cells up to the one with which more than k rows are held
                upto = np.cumsum(rows[order], axis=1)
                near = np.zeros(away.shape, bool)
                np.put_along_axis(near, order, np.append(np.zeros((len(ids), 1)), upto[:, :-1], axis=1) <= k, axis=1)
                if first:
                    bound, wanted = np.full(len(ids), np.inf), near
                else:
                    bound = some.column("bound").to_numpy()
                    least = np.maximum(away - high, low - away) if power >= 1 else np.zeros(away.shape)
                    wanted = ~near & (least <= (bound * (1 + _SLACK))[:, None] + _SLACK * (away + np.abs(high)))
                wanted &= rows > 0
                for cell in np.flatnonzero(wanted.any(axis=0)).tolist():
                    q = wanted[:, cell]
                    row = [(cell, pa.int32()), *((np.ascontiguousarray(v[q]).tobytes(), pa.binary()) for v in (ids, x, bound, away[:, cell]))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names)

    return queries.mapInArrow(ask, "cell int, ids binary, x binary, bound binary, away binary")


def _by_cell(index: CellIndex, queries: DataFrame) -> DataFrame:
    """Queries i, x in order of their nearest center, so that a batch of them asks few cells first."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centers, index.rows, index.scale))
    power = index.power

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, rows, scale = sent.value
        for b in batches if rows.any() else ():
            for at in range(0, len(b), 4096):
                some = b.slice(at, 4096)
                x = _features(some.column("x"))
                own, d = _cells(x if scale is None else x * scale, centers, power)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(d), some.column("i"), some.column("x")], ["cell", "d", "i", "x"])

    found = materialize(queries.mapInArrow(placed, "cell int, d double, i long, x array<double>"), "placed")
    return found.repartitionByRange("cell", "d", "i").sortWithinPartitions("cell", "d", "i").select("i", "x")


def _query_blocks(index: CellIndex, queries: DataFrame) -> DataFrame:
    """Blocks of queries i, x, bound: ids, x, bound (packed), cells (a byte for each cell, 1 where the bounds leave it to be
    looked at) and asked, how often a query of the block is left a cell."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centers, index.rows, index.low, index.high, index.scale))
    power = index.power

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, rows, low, high, scale = sent.value
        for b in batches if rows.any() else ():
            for at in range(0, len(b), _QUERY_ROWS):
                some = b.slice(at, _QUERY_ROWS)
                x, bound = _features(some.column("x")), some.column("bound").to_numpy()
                x = x if scale is None else x * scale
                away = _distances(x, centers, power)
                least = np.maximum(away - high, low - away) if power >= 1 else np.zeros(away.shape)
                wanted = (least <= (bound * (1 + _SLACK))[:, None] + _SLACK * (away + np.abs(high))) & (rows > 0)
                row = [some.column("i").to_numpy().tobytes(), x.tobytes(), bound.tobytes(), wanted.any(axis=0).astype(np.uint8).tobytes()]
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.binary()) for v in row), pa.array([int(wanted.sum())])], ["ids", "x", "bound", "cells", "asked"])

    return queries.mapInArrow(blocks, "ids binary, x binary, bound binary, cells binary, asked long")


def _meet(index: CellIndex, blocks: DataFrame, k: int, queries: int) -> DataFrame:
    """i, j, d: the k nearest rows of each query, no further than its bound, among each part of the rows. `blocks`: those of
    the queries, which meet all rows in a product of parts; rows of a block of queries come one after another."""
    power, rows = index.power, int(index.rows.sum())
    sent = blocks.sparkSession.sparkContext.broadcast(index.centers)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = sent.value
        of, ids, x, bound = None, np.zeros(0, np.int64), None, None
        best: list[tuple] = []  # (place of the query, j, d) of what was found, of which merge() leaves k a query

        def merge() -> None:
            q, n, m = (np.concatenate(v) for v in zip(*best, strict=True))
            order = np.lexsort((n, m, q))
            q, n, m = q[order], n[order], m[order]
            place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(ids)))[q]
            full = place == k - 1
            bound[q[full]] = np.minimum(bound[q[full]], m[full])
            best[:] = [(q[place < k], n[place < k], m[place < k])]

        def emit() -> Iterator[pa.RecordBatch]:
            if best:
                merge()
                q, n, m = best.pop()
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(n), pa.array(m)], ["i", "j", "d"])

        for b in batches:
            for r in range(len(b)):
                if (at := b.column("at")[r].as_py()) != of:
                    yield from emit()
                    of, ids = at, np.frombuffer(b.column("ids")[r].as_py(), np.int64)
                    x, bound = np.frombuffer(b.column("x")[r].as_py(), np.float64).reshape(len(ids), -1), np.frombuffer(b.column("bound")[r].as_py(), np.float64).copy()
                j = np.frombuffer(b.column("row_ids")[r].as_py(), np.int64)
                y = np.frombuffer(b.column("row_x")[r].as_py(), np.float64).reshape(len(j), -1)
                low, high = b.column("low")[r].as_py(), b.column("high")[r].as_py()
                away = _distances(x, centers[b.column("cell")[r].as_py()][None], power)[:, 0]
                least = np.maximum(away - high, low - away) if power >= 1 else np.zeros(len(ids))
                here = np.flatnonzero(least <= bound * (1 + _SLACK) + _SLACK * (away + high))
                if not len(here):
                    continue
                a, c, d = _within(ids[here], x[here], j, y, k, power, bound[here])
                if len(a):
                    best.append((here[a], j[c], d))
                # as many again as are kept: then a bound has something to gain
                if sum(len(v[0]) for v in best[1:]) > k * len(ids):
                    merge()
        yield from emit()

    parts = max(1, -(-rows * index.centers.shape[1] * 8 // _PART_BYTES))
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-queries * rows // _TASK_PAIRS))
    asking = blocks.select(F.monotonically_increasing_id().alias("at"), "ids", "x", "bound", "cells").repartition(max(1, -(-tasks // parts)), "at")
    held = index.blocks.select("cell", F.col("ids").alias("row_ids"), F.col("x").alias("row_x"), "low", "high").repartition(parts)
    wanted = F.expr("substring(cells, cell + 1, 1) = X'01'")
    return asking.join(held.hint("shuffle_replicate_nl"), wanted).drop("cells").mapInArrow(search, _FOUND)


def search(index: CellIndex, queries: DataFrame, id_col: str, features: str, k: int, *, cutoff: float | None = None) -> DataFrame:
    """The k nearest indexed rows of each query but itself, no further than the cutoff: i, j, d, place from 1."""
    if k < 1:
        raise ValueError("k is at least 1")
    far = np.inf if cutoff is None else float(cutoff)
    asked = materialize(_by_cell(index, _scaled(queries, id_col, features)), "queries")
    near = materialize(_look(index, _asked(index, asked, k, True), k), "near")
    best = W.partitionBy("i").orderBy("d", "j")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    kth = near.groupBy("i").agg(F.when(F.count(F.lit(1)) == k, F.max("d")).alias("kth"))
    bounded = asked.join(kth, "i", "left").select("i", "x", F.least(F.coalesce("kth", F.lit(float("inf"))), F.lit(far)).alias("bound"))
    blocks = materialize(_query_blocks(index, bounded), "asked")
    left, n = blocks.agg(F.sum("asked"), F.sum(F.octet_length("ids") / 8).cast("long")).first()
    if (left or 0) <= _SHUFFLED_CELLS * (n or 0):
        more = _look(index, _asked(index, bounded, k, False), k)
        found = near.select("i", "j", "d").unionByName(more)
    else:
        found = _meet(index, blocks, k, n)  # which finds again what the first look found
    found = found.where(F.col("d") <= F.lit(far))
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def neighbour_statistics(df: DataFrame, id_col: str, response: str, features: str, k: int, *, weight: str | None = None, cutoff: float | None = None, reciprocal: tuple[float, float] | None = None, queries: Column | None = None, power: float = 2.0, weights: Sequence[float] | None = None, cells: int | None = None) -> DataFrame:
    """For each row (or those where `queries` is true): its id, `neighbours` (ids in order of distance), and all statistics of
    their distances (d_...) and of their responses (y_...), weighted by their weights and by distance if `reciprocal`
    gives a scale and power. A row without neighbours has an empty list and NULL statistics."""
    index = build_index(df, id_col, features, power=power, weights=weights, cells=cells)
    asking = df if queries is None else df.where(queries)
    near = materialize(search(index, asking, id_col, features, k, cutoff=cutoff), "neighbours")
    weighted = weight is not None or reciprocal is not None
    w = (known(weight) if weight else F.lit(1.0)).cast("double")
    own = df.select(F.col(id_col).cast("long").alias("j"), known(response).alias("y"), w.alias("w"))
    rows = near.join(own, "j")
    if reciprocal:
        rows = rows.withColumn("w", F.col("w") * reciprocal_weights("d", *reciprocal))
    rows = materialize(rows, "responses")
    out = rows.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "j"))), lambda x: x["j"]).alias("neighbours"))
    for column, prefix in (("d", "d"), ("y", "y")):
        got = full_summary(rows, column, "w" if weighted else None, by=["i"])
        out = out.join(got.select("i", *[F.col(c).alias(f"{prefix}_{c}") for c in got.columns if c != "i"]), "i")
    out = asking.select(F.col(id_col).cast("long").alias("i")).join(out, "i", "left")
    return out.withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<long>"))).withColumnRenamed("i", id_col)


#: Names of the statistics of a column, without their prefix.
STATISTICS = ("count", "mean", "std_dev", *[percentile_name(q) for q in PERCENTILES], "mad")
