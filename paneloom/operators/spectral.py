"""Autocorrelation at every lag by a distributed Fourier transform.

A series of n values is padded to N = R * C (powers of two, N >= n + lags). Position t = r * C + c. The transform is done in
two passes: over r for each c, and after a turn by w_N^(c k1) over c for each k1. The products of the spectra need only what
a k1 has, so the second pass transforms back along c at once, and a third pass over k1 gives the sums of all lags t = r *
C + c for each c. Between the passes, tiles (blocks of k1 by blocks of c) are shuffled as bytes: rows and bytes grow with
N, whatever the number of lags. A task holds some 2**18 cells, or C if that is more (2**18 for a series of 2**36).

Values missing at either end of a lag leave its pair out: with the values x around their mean, x * x and the marks k of what
is known, six correlations give the number of pairs and the sums at each lag's two ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.functions.missing import known

_TASK_CELLS = 1 << 18
_TILE = "block long, other long, cells binary"


def _turn(rows: np.ndarray, columns: np.ndarray, n: int, sign: int) -> np.ndarray:
    """exp(sign * 2 pi i * row * column / n), the product reduced exactly first."""
    return np.exp(sign * 2j * np.pi * ((rows[:, None] * columns[None, :]) % n) / n)


def _gathered(table: pa.Table, shape: tuple[int, int], along: int) -> np.ndarray:
    """Tiles of a shape put side by side along an axis, in order of their block."""
    tiles = sorted(zip(table.column("other").to_pylist(), table.column("cells").to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(c, np.complex128).reshape(3, *shape) for _, c in tiles], axis=1 + along)


def _tiles(own: int, cells: np.ndarray, along: int, width: int) -> pa.Table:
    """Cut along an axis in tiles for the blocks of the next pass."""
    count = cells.shape[1 + along] // width
    parts = np.split(cells, count, axis=1 + along)
    return pa.table({"block": pa.array(range(count), pa.int64()), "other": pa.array([own] * count, pa.int64()), "cells": pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())})


def autocorrelation(df: DataFrame, pos: str, value: str, max_lag: int | None = None, *, task_cells: int = _TASK_CELLS) -> DataFrame:
    """lag, corr: Pearson's correlation of the series with itself at lags 1 to max_lag (by default half its length), over the
    pairs of which both are known. Positions are 0 to n - 1; a position without a row is missing. NULL where fewer than
    two pairs, or no variance at one end."""
    spark = df.sparkSession
    x = known(value)
    last, mean = df.agg(F.max(pos), F.avg(x)).first()
    n = 0 if last is None else int(last) + 1
    lags = min(n // 2 if max_lag is None else max_lag, n - 1)
    if lags < 1 or mean is None:
        return spark.createDataFrame([], "lag int, corr double") if lags < 1 else spark.range(1, lags + 1).select(F.col("id").cast("int").alias("lag"), F.lit(None).cast("double").alias("corr"))
    size = max(4, 1 << (n + lags - 1).bit_length())
    bits = size.bit_length() - 1
    rows, columns = 1 << bits // 2, 1 << (bits - bits // 2)
    wide = min(columns, max(1, task_cells // rows))  # columns of a task in the passes over r and k1
    high = min(rows, max(1, task_cells // columns))  # rows of a task in the pass over c
    given = df.select(F.floor(F.pmod(F.col(pos), F.lit(columns)) / wide).alias("block"), F.col(pos).cast("long").alias("t"), (x - F.lit(mean)).alias("x"))

    def down(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        v, t = table.column("x").to_numpy(), table.column("t").to_numpy()
        v, t = v[~np.isnan(v)], t[~np.isnan(v)]
        cells = np.zeros((3, rows, wide))
        at = (t // columns, t % columns - block * wide)
        for k, part in enumerate((v, np.ones(len(v)), v * v)):
            cells[k][at] = part
        turned = np.fft.fft(cells, axis=1) * _turn(np.arange(rows), block * wide + np.arange(wide), size, -1)
        return _tiles(block, turned, 0, high)

    def across(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        full = _gathered(table, (high, wide), 1)
        if full.shape[2] < columns:  # blocks of columns without any value
            have = sorted(table.column("other").to_pylist())
            whole = np.zeros((3, high, columns), complex)
            for i, b in enumerate(have):
                whole[:, :, b * wide : (b + 1) * wide] = full[:, :, i * wide : (i + 1) * wide]
            full = whole
        a, k, q = np.fft.fft(full, axis=2)
        # two real sums in the parts of each complex one: pairs and products, sums of both ends, squares of both ends
        packed = np.stack([np.conj(k) * k + 1j * np.conj(a) * a, np.conj(a) * k + 1j * np.conj(k) * a, np.conj(q) * k + 1j * np.conj(k) * q])
        back = np.fft.ifft(packed, axis=2) * _turn(block * high + np.arange(high), np.arange(columns), size, 1)
        return _tiles(block, back, 1, wide)

    def up(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        sums = np.fft.ifft(_gathered(table, (high, wide), 0), axis=1)
        lag = np.arange(rows)[:, None] * columns + block * wide + np.arange(wide)[None, :]
        wanted = (lag >= 1) & (lag <= lags)
        lag = lag[wanted]
        (m, xy), (sa, sb), (saa, sbb) = ((s[wanted].real, s[wanted].imag) for s in sums)
        m = np.rint(m)
        with np.errstate(invalid="ignore", divide="ignore"):
            va, vb = saa - sa * sa / m, sbb - sb * sb / m
            corr = np.clip((xy - sa * sb / m) / np.sqrt(va * vb), -1.0, 1.0)
        # what rounding leaves of no variance at all
        none = (m < 2) | ~(va > 1e-12 * np.abs(saa).max(initial=0.0)) | ~(vb > 1e-12 * np.abs(sbb).max(initial=0.0))
        return pa.table({"lag": pa.array(lag.astype(np.int32)), "corr": pa.array(corr, mask=none | np.isnan(corr))})

    tiles = given.groupBy("block").applyInArrow(down, _TILE)
    tiles = tiles.groupBy("block").applyInArrow(across, _TILE)
    return tiles.groupBy("block").applyInArrow(up, "lag int, corr double")
