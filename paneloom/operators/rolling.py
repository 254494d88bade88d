"""Rolling statistics of consecutive rows: all moments, nine weighted quantiles and MAD of each window, or the cross moments
of several variables.

Positions are cut in chunks of at least a window's length. A chunk is given the rows of the next one that its windows
reach into, so each row is written at most twice, whatever the overlap. In a chunk, rows are sorted by value once; a window's
sorted values are those of the chunk's order that lie inside it, and cross moments are differences of running sums around
the chunk's own means. A window of more than `CHUNK_ROWS` rows would not fit in a task: there windows are groups, and rows
are copied size / offset times (overlap, 5 in the usual call).

Rows of a missing value or of missing or non-positive weight count in `size` alone. With one valid row only the median of
the quantiles is defined. Positions are 0 to n - 1, each once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.missing import known

from .multivariate import moment_matrix, moment_sums
from .quantiles import PERCENTILES, percentile_name
from .relational import ordinal
from .stats import extremes, summary
from .windows import in_windows, size_offset

#: Most rows of a window that a task holds, and least rows of a chunk.
CHUNK_ROWS, LEAST_CHUNK = 1 << 20, 1 << 14
_CELLS = 1 << 20

_MOMENTS = ("d_count", "mean_wt", "sum", "mean", "sum_square", "mean_square", "variance", "std_dev", "std_err", "t_stat")
_SPARSE = "window long, size long, count long, " + ", ".join(f"{m} double" for m in _MOMENTS) + ", min double, min_id long, max double, max_id long"
_FULL = _SPARSE + ", " + ", ".join(f"{percentile_name(q)} double" for q in PERCENTILES) + ", mad double"


def _in_chunks(df: DataFrame, pos: str, size: int, chunk: int) -> DataFrame:
    """Each row in the chunk of its position, and in the one before if windows that begin there reach it."""
    at = F.floor(F.col(pos) / chunk)
    reached = (F.col(pos) % chunk < size - 1) & (at > 0)
    return df.withColumn("_chunk", F.explode(F.when(reached, F.array(at, at - 1)).otherwise(F.array(at))))


def _starts(chunk: int, size: int, offset: int, n: int, rows: int) -> np.ndarray:
    """Where the full windows begin that begin in a chunk."""
    first = -(-chunk * rows // offset) * offset
    return np.arange(first, min((chunk + 1) * rows, n - size + 1), offset)


def sorted_quantiles(x: np.ndarray, w: np.ndarray, quantiles: Sequence[float]) -> np.ndarray:
    """Interpolated weighted quantiles of each row of x (sorted; rows of weight 0 last) as `quantiles` defines them."""
    rows, size = x.shape
    cum = np.cumsum(w, axis=1)
    total, n = cum[:, -1], (w > 0).sum(axis=1)
    new = np.ones(x.shape, bool)
    new[:, 1:] = x[:, 1:] != x[:, :-1]
    first = np.flatnonzero(new)  # where each run of equal values begins
    step = np.cumsum(new.ravel()) - 1
    lightest = np.minimum.reduceat(w.ravel(), first)
    line = np.arange(rows)
    out = np.full((len(quantiles), rows), np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        for i, q in enumerate(quantiles):
            t = q * total + total / n / 2
            k = (cum < t[:, None]).sum(axis=1)
            beyond = k >= n
            flat = line * size + np.minimum(k, size - 1)
            run = step[flat]
            begin = first[run] - line * size
            top = x.ravel()[flat]
            before = x.ravel()[line * size + np.maximum(begin - 1, 0)]
            rise = (t - cum.ravel()[line * size + np.maximum(begin - 1, 0)]) / lightest[run]
            value = np.where((begin == 0) | (rise >= 1), top, before + (top - before) * rise)
            out[i] = np.where(beyond, x.ravel()[line * size + np.maximum(n - 1, 0)], value)
            out[i][n == 0] = np.nan
    return out


def _window_statistics(pos: np.ndarray, x: np.ndarray, w: np.ndarray, starts: np.ndarray, size: int, offset: int, full: bool, weighted: bool) -> dict[str, np.ndarray]:
    """Statistics of the windows of a chunk whose positions are in order; w is 0 where a row does not count."""
    x = np.where(w > 0, x, np.inf)
    order = np.lexsort((pos, x))
    place = pos[order]
    out: dict[str, list] = {}
    some = max(1, _CELLS // max(len(pos), 1))
    for at in range(0, len(starts), some):
        begin = starts[at : at + some]
        inside = (place >= begin[:, None]) & (place < begin[:, None] + size)
        index = order[np.nonzero(inside)[1].reshape(len(begin), size)]
        v, u, p = x[index], w[index], pos[index]
        held = u > 0
        count = held.sum(axis=1)
        z = np.where(held, v, 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            total = u.sum(axis=1)
            mean = (u * z).sum(axis=1) / total
            far = np.where(held, z - mean[:, None], 0.0)
            lean = (u * far).sum(axis=1) / total
            variance = np.where(count > 1, np.maximum((u * far * far).sum(axis=1) / total - lean * lean, 0.0), np.nan)
            square = (u * z * z).sum(axis=1) / total
            d_count = total * total / (u * u).sum(axis=1) if weighted else total
            std_dev = np.sqrt(variance)
            std_err = std_dev / np.sqrt(d_count)
            values = {"window": begin // offset, "size": np.full(len(begin), size), "count": count, "d_count": d_count, "mean_wt": total / count, "sum": mean * count, "mean": mean, "sum_square": square * count, "mean_square": square, "variance": variance, "std_dev": std_dev, "std_err": std_err, "t_stat": np.where(std_err > 0, mean / std_err, np.nan)}
        line, last = np.arange(len(begin)), np.maximum(count - 1, 0)
        top = v[line, last]
        top_at = (v < top[:, None]).sum(axis=1)  # the first of the greatest
        none = count == 0
        for name, (number, ids) in {"min": (v[:, 0], p[:, 0]), "max": (top, p[line, np.minimum(top_at, size - 1)])}.items():
            values[name] = np.where(none, np.nan, number)
            values[f"{name}_id"] = np.ma.array(ids, mask=none)
        if full:
            found = sorted_quantiles(v, u, PERCENTILES)
            for q, column in zip(PERCENTILES, found, strict=True):
                values[percentile_name(q)] = column if q == 0.5 else np.where(count == 1, np.nan, column)
            with np.errstate(invalid="ignore"):
                away = np.where(held, np.abs(v - values["median"][:, None]), np.inf)
            again = np.argsort(away, axis=1, kind="stable")  # two sorted runs meet
            mad = sorted_quantiles(np.take_along_axis(away, again, 1), np.take_along_axis(u, again, 1), [0.5])[0]
            values["mad"] = np.where(count == 1, np.nan, mad)
        for name, column in values.items():
            out.setdefault(name, []).append(column)
    return {name: np.ma.concatenate(c) if name.endswith("_id") else np.concatenate(c) for name, c in out.items()}


def _arrow(columns: dict[str, np.ndarray], names: Sequence[str]) -> pa.Table:
    def array(c: np.ndarray) -> pa.Array:
        if isinstance(c, np.ma.MaskedArray):
            return pa.array(c.data.astype(np.int64), mask=np.ma.getmaskarray(c))
        return pa.array(c, mask=np.isnan(c)) if c.dtype.kind == "f" else pa.array(c.astype(np.int64))

    return pa.table({n: array(columns[n]) for n in names})


def rolling_summary(df: DataFrame, pos: str, value: str, weight: str | None = None, *, size: float = 0.05, overlap: float = 5, offset: int | None = None, fit_edges: bool = True, full: bool = True, n: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A row for each full window: window, size, count, moments, extremes with their positions, and with `full` nine quantiles
    and mad. `offset` is given, or follows from `overlap`; then a size of at most 1 is a share of the rows."""
    n = df.count() if n is None else n
    if offset is None:
        size, offset = size_offset(n, size, overlap, fit_edges)
    else:
        size = int(size)
    if size < 1:
        raise ValueError("a window has at least one row")
    schema = _FULL if full else _SPARSE
    w = F.lit(1.0) if weight is None else known(weight)
    rows = df.select(F.col(pos).cast("long").alias("_pos"), known(value).alias("_x"), w.alias("_w"))
    if size > chunk_rows:
        quantiles = {"quantiles": PERCENTILES, "mad": True} if full else {}
        placed = in_windows(rows, "_pos", n, size, offset)
        ends = placed.groupBy("window").agg(*[c.alias(f"_{k}") for k, c in extremes("_x", "_pos", "_w").items()])
        got = summary(placed, "_x", "_w", by=["window"], statistics=("size", "count", *_MOMENTS, "min", "max"), **quantiles).join(ends, "window")
        got = got.withColumns({"min_id": F.col("_min_id"), "max_id": F.col("_max_id")})
        return got.select(*[f.split()[0] for f in schema.split(", ")])
    chunk = max(size, min(LEAST_CHUNK, chunk_rows))
    names = [f.split()[0] for f in schema.split(", ")]

    def of_chunk(key: tuple, table: pa.Table) -> pa.Table:
        place = table.column("_pos").to_numpy()
        order = np.argsort(place)
        x, u = (table.column(c).to_numpy()[order] for c in ("_x", "_w"))
        u = np.where(np.isnan(x) | np.isnan(u) | (u <= 0), 0.0, u)
        starts = _starts(key[0].as_py(), size, offset, n, chunk)
        if not len(starts):
            return pa.table({k: pa.array([], pa.float64() if k not in ("window", "size", "count", "min_id", "max_id") else pa.int64()) for k in names})
        # small parts at a time: what a window's mask covers is then of the order of the window
        parts: dict[str, list] = {}
        place = place[order]
        stride = max(size, 256)
        for low in range(int(starts[0]), int(starts[-1]) + 1, stride):
            here = starts[(starts >= low) & (starts < low + stride)]
            if len(here):
                a, b = np.searchsorted(place, [here[0], here[-1] + size])
                for k, c in _window_statistics(place[a:b], x[a:b], u[a:b], here, size, offset, full, weight is not None).items():
                    parts.setdefault(k, []).append(c)
        return _arrow({k: np.ma.concatenate(c) if k.endswith("_id") else np.concatenate(c) for k, c in parts.items()}, names)

    return _in_chunks(rows, "_pos", size, chunk).groupBy("_chunk").applyInArrow(of_chunk, schema)


def rolling_multivariate(df: DataFrame, pos: str, variables: Sequence[str], weight: str | None = None, *, size: float = 0.05, overlap: float = 5, offset: int | None = None, fit_edges: bool = True, n: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cross moments of each full window over pairwise-complete rows: window, i, j and the statistics of `moment_matrix`."""
    n = df.count() if n is None else n
    if offset is None:
        size, offset = size_offset(n, size, overlap, fit_edges)
    else:
        size = int(size)
    if size < 1:
        raise ValueError("a window has at least one row")
    k = len(variables)
    w = F.lit(1.0) if weight is None else known(weight)
    rows = df.select(F.col(pos).cast("long").alias("_pos"), w.alias("_w"), *[known(v).alias(f"_x{i}") for i, v in enumerate(variables)])
    if size > chunk_rows:
        sums = in_windows(rows, "_pos", n, size, offset).groupBy("window").agg(*moment_sums([f"_x{i}" for i in range(k)], "_w"))
        return moment_matrix(sums, variables, ["window"])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    kinds = ["window long", *[f"h{i} double" for i in range(k)], *[f"s{i} double" for i in range(k)]]
    for i, j in pairs:
        kinds += [f"p{i}_{j} double", f"u{i}_{j} double", f"c{i}_{j} long", f"v{i}_{j} double"] + ([f"a{i}_{j} double", f"b{i}_{j} double"] if i < j else [])
    chunk = max(size, min(LEAST_CHUNK, chunk_rows))

    def of_chunk(key: tuple, table: pa.Table) -> pa.Table:
        place = table.column("_pos").to_numpy()
        order = np.argsort(place)
        u = table.column("_w").to_numpy()[order]
        u = np.where(np.isnan(u) | (u <= 0), 0.0, u)
        columns = [table.column(f"_x{i}").to_numpy()[order] for i in range(k)]
        known_ = [~np.isnan(c) & (u > 0) for c in columns]
        shifts = [float(c[ok].mean()) if ok.any() else 0.0 for c, ok in zip(columns, known_, strict=True)]
        x = [np.where(ok, c - s, 0.0) for c, ok, s in zip(columns, known_, shifts, strict=True)]
        starts = _starts(key[0].as_py(), size, offset, n, chunk)
        begin = np.searchsorted(place[order], starts)

        def over(values: np.ndarray) -> np.ndarray:
            running = np.append(0, np.cumsum(values))
            return running[begin + size] - running[begin]

        out: dict[str, np.ndarray] = {"window": starts // offset}
        for i in range(k):
            out[f"h{i}"] = np.full(len(starts), shifts[i])
            count = over(known_[i].astype(np.int64))
            out[f"s{i}"] = np.where(count > 0, over(u * x[i]), np.nan)
        for i, j in pairs:
            both = known_[i] & known_[j]
            weights = np.where(both, u, 0.0)
            count = over(both.astype(np.int64))
            sums = {"p": weights * x[i] * x[j], "u": weights, "v": weights * weights} | ({"a": weights * x[i], "b": weights * x[j]} if i < j else {})
            out[f"c{i}_{j}"] = count
            for name, v in sums.items():
                out[f"{name}{i}_{j}"] = np.where(count > 0, over(v), np.nan)
        return _arrow(out, [c.split()[0] for c in kinds])

    sums = _in_chunks(rows, "_pos", size, chunk).groupBy("_chunk").applyInArrow(of_chunk, ", ".join(kinds))
    return moment_matrix(sums, variables, ["window"], [F.col(f"h{i}") for i in range(k)])


def nearest_summary(df: DataFrame, x: str, y: str | Sequence[str], tie: str | Column, x_weight: str | None = None, y_weight: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Rolling statistics of x and of y over rows in order of x (rows without x dropped): two tables with a row for each
    window. With one weight it counts for both. Several y give cross moments."""
    x_weight, y_weight = x_weight or y_weight, y_weight or x_weight
    rows = df.where(known(x).isNotNull())
    placed = ordinal(rows, [known(x), F.col(tie) if isinstance(tie, str) else tie], "_at")
    n = rows.count()
    of_x = rolling_summary(placed, "_at", x, x_weight, n=n, **options)
    if isinstance(y, str):
        return of_x, rolling_summary(placed, "_at", y, y_weight, n=n, **options)
    return of_x, rolling_multivariate(placed, "_at", y, y_weight, n=n, **{k: v for k, v in options.items() if k != "full"})
