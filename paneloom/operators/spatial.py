"""Distances, nearest neighbours, points in polygons and density peaks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneloom.functions.missing import col, known
from paneloom.functions.scalars import reciprocal_weights
from paneloom.plans.shared import materialize

EARTH_KM = 6371.0


def minkowski(a: Column, b: Column, power: float = 2.0, weights: Sequence[float] | None = None) -> Column:
    """Minkowski distance of two arrays; features are first scaled by their share of the weights."""
    scaled = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if weights is not None:
        total = float(sum(weights))
        scaled = F.zip_with(scaled, F.array(*[F.lit(w / total) for w in weights]), lambda d, w: d * w)
    return F.pow(F.aggregate(scaled, F.lit(0.0), lambda s, d: s + F.pow(d, F.lit(float(power)))), F.lit(1.0 / power))


#: Rows of a block of the distance matrix, rows of it for which distances are held at once, and most parts of a side.
_MATRIX_ROWS, _MATRIX_STRIP, _MATRIX_PARTS = 1024, 128, 64
#: Pairs after which the same ones follow the other way: so near that a file's compressor finds their distances again.
_MATRIX_TURN = 128


def _by_turns(n: int) -> np.ndarray:
    """Order of 2 * n rows, of which the second n are the first ones the other way: turns of the first, each before its other."""
    at = np.arange(n)
    return np.argsort(np.concatenate([at // _MATRIX_TURN * 2, at // _MATRIX_TURN * 2 + 1]), kind="stable").astype(np.int32)


def _strip(x: np.ndarray, y: np.ndarray, power: float) -> np.ndarray:
    """Distances of all columns of x from all columns of y (a row for each feature), summed feature by feature."""
    out, step = np.zeros((x.shape[1], y.shape[1])), np.empty((x.shape[1], y.shape[1]))
    for f in range(x.shape[0]):
        np.subtract(x[f][:, None], y[f], out=step)
        if power == 2:
            np.multiply(step, step, out=step)
        else:
            np.power(np.abs(step, out=step), power, out=step)
        out += step
    return np.sqrt(out, out=out) if power == 2 else np.power(out, 1.0 / power, out=out)


def _matrix_blocks(batches: Iterator[pa.RecordBatch], rows: int, scale: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Blocks of ids, of their features by column, and of the number of features: -1 where some are missing."""
    names = ["ids", "x", "n"]
    for b in batches:
        for at in range(0, len(b), rows):
            some = b.slice(at, rows)
            features = some.column("x").to_pylist()
            n = np.array([-1 if f is None or None in f or (scale is not None and len(f) != len(scale)) else len(f) for f in features], np.int32)
            x = np.zeros((max(int(n.max()), 0), len(n)))
            for k in np.flatnonzero(n > 0):
                x[: n[k], k] = features[k] if scale is None else np.array(features[k], float) * scale
            own = some.column("i")
            ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names)


def _matrix_cells(batches: Iterator[pa.RecordBatch], power: float, digits: int | None) -> Iterator[pa.RecordBatch]:
    """All pairs of two blocks, both ways; of one block with itself, each of its rows with all others."""
    names = ["i", "j", "d"]
    turns: dict[int, np.ndarray] = {}
    for b in batches:
        for r in range(len(b)):
            i, j = (b.column(c)[r].values for c in ("a_ids", "b_ids"))
            both, shared = pa.concat_arrays([i, j]), pc.any(pc.is_in(i, j)).as_py()
            n, m = (np.frombuffer(b.column(c)[r].as_py(), np.int32) for c in ("a_n", "b_n"))
            x, y = (np.frombuffer(b.column(c)[r].as_py(), np.float64).reshape(-1, len(k)) for c, k in (("a_x", n), ("b_x", m)))
            width = min(len(x), len(y))  # what is longer in one of the blocks has no equal in the other
            same = b.column("a")[r].as_py() == b.column("b")[r].as_py()
            for at in range(0, len(n), _MATRIX_STRIP):
                own = n[at : at + _MATRIX_STRIP]
                d = _strip(x[:width, at : at + _MATRIX_STRIP], y[:width], power).ravel()
                if digits is not None:
                    d = np.floor(d * 10.0**digits + 0.5) / 10.0**digits
                missing = ((own[:, None] != m) | (own[:, None] < 0)).ravel()
                left = np.repeat(np.arange(at, at + len(own), dtype=np.int32), len(m))
                right = np.tile(np.arange(len(m), dtype=np.int32), len(own))
                ids = i
                if not same:
                    if len(d) not in turns:
                        turns[len(d)] = _by_turns(len(d))
                    order, ids, right = turns[len(d)], both, right + np.int32(len(n))
                    left, right = np.concatenate([left, right])[order], np.concatenate([right, left])[order]
                    d, missing = np.concatenate([d, d])[order], np.concatenate([missing, missing])[order]
                left, right = ids.take(pa.array(left)), ids.take(pa.array(right))
                cells = pa.RecordBatch.from_arrays([left, right, pa.array(d, mask=missing if missing.any() else None)], names)
                yield cells.filter(pc.not_equal(left, right)) if same or shared else cells


def distance_matrix(df: DataFrame, id_col: str, features: str, *, power: float = 2.0, weights: Sequence[float] | None = None, digits: int | None = None, block: int = _MATRIX_ROWS) -> DataFrame:
    """All pairs i, j (both ways), d, rounded half up to `digits` if given; NULL where features are missing or not as many.

    The result is quadratic by definition. Blocks of rows meet in a product of parts that is neither broadcast nor shuffled
    as pairs; of two blocks one order is kept, by turns, so that all tasks have like shares, and gives both directions. A
    task holds two parts' blocks and distances of `_MATRIX_STRIP` rows from a block.
    """
    scale = None if weights is None else np.array(weights, float) / float(sum(weights))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(features).cast("array<double>").alias("x"))
    kind = rows.schema["i"].dataType.simpleString()
    blocks = rows.mapInArrow(partial(_matrix_blocks, rows=block, scale=scale), f"ids array<{kind}>, x binary, n binary")
    blocks = materialize(blocks.withColumn("at", F.monotonically_increasing_id()), "blocks")
    parts = max(1, min(blocks.count(), _MATRIX_PARTS))
    a, b = (blocks.repartitionByRange(parts, "at").select(F.col("at").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "x", "n")]) for s in "ab")
    once = (F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) == ((F.col("a") + F.col("b")) % 2 == 0))
    return a.join(b.hint("shuffle_replicate_nl"), once).mapInArrow(partial(_matrix_cells, power=power, digits=digits), f"i {kind}, j {kind}, d double")


def knn(distances: DataFrame, k: int, cutoff: float | None = None) -> DataFrame:
    """The k nearest of each i (ties by j), no further than the cutoff: i, j, d, place."""
    rows = distances.where("i <> j")
    if cutoff is not None:
        rows = rows.where(F.col("d") <= cutoff)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("i").orderBy("d", "j"))).where(F.col("place") <= k)


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ids and of their features, as bytes."""
    ids, x = [], []

    def block() -> pa.RecordBatch:
        values = np.array(x, np.float64)
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([values.tobytes()])], names=["ids", "x"])

    for b in batches:
        for i, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            x.append(f)
            if len(ids) == rows:
                yield block()
                ids, x = [], []
    if ids:
        yield block()


def _nearest(batches: Iterator[pa.RecordBatch], k: int, power: float, weights: list[float] | None, cutoff: float | None) -> Iterator[pa.RecordBatch]:
    """The k nearest of each row of one block among the rows of another. Candidates come from a matrix product where the
    power is 2, with a margin above its rounding; their distances are then summed feature by feature."""
    for b in batches:
        for columns in zip(*(c.to_pylist() for c in b.columns)):
            i, j = (np.frombuffer(columns[at], np.int64) for at in (0, 2))
            x, y = (np.frombuffer(columns[at], np.float64).reshape(len(n), -1) for at, n in ((1, i), (3, j)))
            if weights is not None:
                x, y = (v * (np.array(weights) / sum(weights)) for v in (x, y))
            if power == 2:
                xx, yy = (x * x).sum(1), (y * y).sum(1)
                near = xx[:, None] + yy - 2 * (x @ y.T)
                margin = 8 * np.finfo(float).eps * (x.shape[1] + 8) * (xx + yy.max())
            else:
                near, margin = np.zeros((len(i), len(j))), np.zeros(len(i))
                for f in range(x.shape[1]):
                    near += np.abs(x[:, f, None] - y[:, f]) ** power
            if len(np.intersect1d(i, j)):
                near[i[:, None] == j] = np.inf
            bound = np.partition(near, k - 1, axis=1)[:, k - 1] if k < len(j) else np.full(len(i), np.inf)
            a, c = np.nonzero((near <= (bound + margin)[:, None]) & (near < np.inf))
            d = np.zeros(len(a))
            for f in range(x.shape[1]):
                d += np.abs(x[a, f] - y[c, f]) ** power
            got = pd.DataFrame({"i": i[a], "j": j[c], "d": d ** (1.0 / power)})
            got = (got if cutoff is None else got[got["d"] <= cutoff]).sort_values(["i", "d", "j"])
            yield pa.RecordBatch.from_pandas(got[got.groupby("i").cumcount() < k], preserve_index=False)


def nearest(df: DataFrame, id_col: str, features: str, k: int, *, power: float = 2.0, weights: Sequence[float] | None = None, cutoff: float | None = None, block: int = 1024) -> DataFrame:
    """What `knn` gives on the whole `distance_matrix`, without its rows: i, j, d, place. Ids are integers and unique.

    Every pair of blocks of rows is compared once in a task, which keeps k for each row and block. Rows with missing
    features are nobody's neighbours and have none.
    """
    whole = df.where(F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull() | F.isnan(x)))
    # equal sizes of blocks, however many files the table has
    parts = max(1, -(-whole.count() // block))
    packed = whole.select(F.col(id_col).cast("long").alias("i"), F.col(features).cast("array<double>").alias("x")).repartition(parts)
    packed = materialize(packed.mapInArrow(partial(_packed, rows=2 * block), "ids binary, x binary"), "blocks")
    pairs = packed.crossJoin(packed.select(F.col("ids").alias("ids2"), F.col("x").alias("x2")))
    close = partial(_nearest, k=k, power=float(power), weights=None if weights is None else [float(w) for w in weights], cutoff=cutoff)
    return knn(pairs.mapInArrow(close, "i long, j long, d double"), k)


def knn_stats(df: DataFrame, id_col: str, response: str, distances: DataFrame, k: int, *, weight: str | None = None, cutoff: float | None = None, reciprocal: tuple[float, float] | None = None) -> DataFrame:
    """For each row: count of neighbours, mean distance, weighted mean of their responses. `neighbors.neighbour_statistics` gives
    all statistics of both, and the neighbours."""
    own = df.select(F.col(id_col).alias("j"), known(response).alias("_y"), (known(weight) if weight else F.lit(1.0)).alias("_w"))
    near = knn(distances, k, cutoff).join(own, "j")
    w = F.col("_w") * (reciprocal_weights("d", *reciprocal) if reciprocal else F.lit(1.0))
    u = F.when(F.col("_y").isNotNull() & (w > 0), w)
    mean = F.sum(u * F.col("_y")) / F.sum(u)
    got = near.groupBy("i").agg(F.count("d").alias("neighbours"), F.avg("d").alias("mean_distance"), mean.alias("mean"))
    return df.select(F.col(id_col).alias("i")).join(got, "i", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def gc_distance(lat1, lon1, lat2, lon2, degrees: bool = False) -> Column:
    """Great-circle kilometres by the haversine; radians unless `degrees`."""
    a, b, c, d = (F.radians(col(x)) if degrees else col(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geo_matrix(df: DataFrame, id_col: str, lat: str, lon: str) -> DataFrame:
    """All pairs of points in degrees: i, j, km."""
    a = df.select(F.col(id_col).alias("i"), F.col(lat).alias("_a"), F.col(lon).alias("_b"))
    b = df.select(F.col(id_col).alias("j"), F.col(lat).alias("_c"), F.col(lon).alias("_d"))
    return a.crossJoin(b).select("i", "j", gc_distance("_a", "_b", "_c", "_d", True).alias("km"))


def point_in_polygon(x, y, polygon: Sequence[tuple[float, float]]) -> Column:
    """Ray casting: odd crossings of edges with min(y) < y <= max(y), x <= max(x)."""
    px, py = known(x), known(y)
    crossings = F.lit(0)
    for i, (x1, y1) in enumerate(polygon):
        x2, y2 = polygon[(i + 1) % len(polygon)]
        if y1 == y2:
            continue
        inside = (py > min(y1, y2)) & (py <= max(y1, y2)) & (px <= max(x1, x2))
        at = (py - y1) * ((x2 - x1) / (y2 - y1)) + x1
        hit = inside if x1 == x2 else inside & (px <= at)
        crossings = crossings + F.coalesce(hit, F.lit(False)).cast("int")
    return crossings % 2 == 1


def density_window(shape: Sequence[float], window: tuple[str, float] | str, bins: int, circular: bool) -> tuple[np.ndarray, np.ndarray]:
    """A smoothing window over grid cells, and which of its cells count; its mean over these is 1.

    A side below 1 is a share of the bins; sides are odd numbers of cells. `window` is 'boxcar' or ('gaussian', width), the
    width in cells or below 1 as a share of the side. As with periodic windows, a gaussian's middle lies half a cell past
    that of its side. `circular` keeps the cells of the ellipse inside.
    """
    sides = [int(s * bins) if s < 1 else int(s) for s in shape]
    sides = [s + 1 - s % 2 for s in sides]
    kind, width = (window, 0.0) if isinstance(window, str) else window
    if kind == "boxcar":
        along = [np.ones(s) for s in sides]
    elif kind == "gaussian":
        widths = [int(width * s) if width < 1 else width for s in sides]
        if min(widths) <= 0:
            raise ValueError(f"a gaussian of width {width} is no cell wide on sides of {sides}")
        along = [np.exp(-0.5 * ((np.arange(s) - s / 2) / w) ** 2) for s, w in zip(sides, widths, strict=True)]
    else:
        raise ValueError(f"unknown window {kind}")
    weight = np.outer(along[1], along[0])
    mask = np.ones(weight.shape, bool)
    if circular:
        far = [np.linspace(-1, 1, n) if n > 1 else np.zeros(1) for n in weight.shape]
        mask = far[0][:, None] ** 2 + far[1][None, :] ** 2 <= 1
    weight = np.where(mask, weight, 0.0)
    return weight * mask.sum() / weight.sum(), mask


def dense_centers(counts: np.ndarray, weight: np.ndarray, mask: np.ndarray, k: int | None, least: float) -> list[tuple[int, int, float, float]]:
    """Cells of the densest places one after another: row, column, smoothed count, and the count in cells that became dense.

    Places whose window fits in the grid are smoothed by convolution over the cells that no earlier center has taken, and are
    centers only if no earlier one took them. The last center is the first whose own count is at most `least`.
    """
    size, half = weight.shape, [(s - 1) // 2 for s in weight.shape]
    taken = np.zeros(counts.shape, bool)
    limit = counts.size - mask.sum()
    out: list[tuple[int, int, float, float]] = []
    if any(n < s for n, s in zip(counts.shape, size, strict=True)):
        return out
    turned = weight[::-1, ::-1]
    while not out or (len(out) < (k or counts.size) and out[-1][3] > least and taken.sum() < limit):
        free = np.where(taken, 0, counts)
        smooth = np.einsum("ijuv,uv->ij", np.lib.stride_tricks.sliding_window_view(free, size), turned)
        middle = taken[half[0] : half[0] + smooth.shape[0], half[1] : half[1] + smooth.shape[1]]
        open_ = np.where(middle, -np.inf, smooth)
        i, j = np.unravel_index(open_.argmax(), open_.shape)
        if middle[i, j]:
            break
        before = taken.copy()
        taken[i : i + size[0], j : j + size[1]] |= mask
        out.append((int(i) + half[0], int(j) + half[1], float(smooth[i, j]), float(counts[taken & ~before].sum())))
    return out


class DensityPeaks:
    """Centers of two-dimensional density. The histogram is an aggregate with partial counts; its grid has bins x bins cells, so
    what is smoothed and searched on the driver is bounded by `bins`, whatever the rows. `min_count` below 1 is a share of
    the rows."""

    def __init__(self, k: int | None = 100, *, min_count: float = 0.0005, bins: int = 100, window: tuple[str, float] | str = ("gaussian", 0.3), shape: Sequence[float] = (0.1, 0.1), circular: bool = True):
        self.k, self.min_count, self.bins = k, min_count, bins
        self.weight, self.mask = density_window(shape, window, bins, circular)

    def fit(self, df: DataFrame, x: str, y: str, range: tuple | None = None) -> DensityPeaks:
        """Rows outside `range`, or without a coordinate, do not count; a last bin holds its upper end."""
        a, b = known(x), known(y)
        rows = df.where(a.isNotNull() & b.isNotNull())
        (lo_x, hi_x), (lo_y, hi_y) = range or [v[:2] for v in zip(*[iter(rows.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first())] * 2, strict=True)]
        self.centers: list[tuple[float, float, float, float]] = []
        self.grid = np.zeros((self.bins, self.bins))
        if lo_x is None:
            return self
        # a side of no extent is a unit around its value
        (lo_x, hi_x), (lo_y, hi_y) = ((lo - 0.5, hi + 0.5) if lo == hi else (lo, hi) for lo, hi in ((lo_x, hi_x), (lo_y, hi_y)))

        def cell(v: Column, lo: float, hi: float) -> Column:
            return F.least(F.floor((v - lo) / (hi - lo) * self.bins), F.lit(self.bins - 1)).cast("int")

        inside = rows.where((a >= lo_x) & (a <= hi_x) & (b >= lo_y) & (b <= hi_y))
        for r in inside.groupBy(cell(a, lo_x, hi_x).alias("i"), cell(b, lo_y, hi_y).alias("j")).agg(F.count(F.lit(1)).alias("n")).collect():
            self.grid[r["i"], r["j"]] = r["n"]
        least = self.min_count if self.min_count >= 1 else self.grid.sum() * self.min_count
        for i, j, weight, count in dense_centers(self.grid, self.weight, self.mask, self.k, least):
            self.centers.append((lo_x + (i + 0.5) * (hi_x - lo_x) / self.bins, lo_y + (j + 0.5) * (hi_y - lo_y) / self.bins, weight, count))
        return self

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(self.centers)], "place int, x double, y double, density double, count double")
