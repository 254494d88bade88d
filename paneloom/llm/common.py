"""What several operators share: the word pattern, reading a table, a cache that outlives one task."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: Words of all contracts: runs of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], name: str) -> str:
    """The name, lengthened until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_below(c: Column, share: float) -> Column:
    """Whether a 64-bit hash of a column is among the lowest share: a sample of any size, however small its share."""
    edge = int(-(2**63) + min(1.0, max(0.0, share)) * 2**64)
    return F.lit(True) if edge >= 2**63 else F.xxhash64(c) < F.lit(edge)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def worker_cache() -> dict:
    """A dict that lasts as long as the Python worker; functions sent by value have new globals in each task."""
    return sys.modules.setdefault("_paneloom_worker", types.ModuleType("_paneloom_worker")).__dict__


def leave_cache() -> None:
    """In a worker: free what another operator keeps there, also the C allocator's share of it."""
    import ctypes

    held = worker_cache()
    kept = [k for k in held if isinstance(k, tuple)]
    for k in kept:
        del held[k]
    if kept and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a worker: the batches; after each, what Arrow's allocator holds free goes back to the system. By itself it keeps the
    most that any batch ever took, beside what the operator and the next ones need, as long as the worker lives."""
    import pyarrow as pa

    pool = pa.default_memory_pool()
    for b in batches:
        yield b
        del b
        pool.release_unused()


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As `released`; after the last one the C allocator's free memory goes back too, as a worker lives on for other tasks."""
    import ctypes

    yield from released(batches)
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Arrow batches of at most so many rows and bytes, for the whole session: JVM and worker each hold several of them for
    each core, and at the default of 10,000 rows of text they are the largest part of a worker."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:  # 0 or less: no limit
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def terms_table(kept: str) -> bytes:
    """For `term_runs`: a byte map that keeps `kept` and all of UTF-8's bytes beyond ASCII, lowers A-Z and blanks the rest."""
    keep = set(kept.encode()) | set(range(128, 256))
    return bytes(b | 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))


_LOWER = "abcdefghijklmnopqrstuvwxyz"
LETTERS, LETTERS_AND_DIGITS = terms_table(_LOWER), terms_table(_LOWER + "0123456789")


def term_runs(text: bytes | None, table: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, as lists from about `size` bytes each, so that a long text never is one list."""
    blanked = (text or b"").translate(table)
    at = 0
    while at < len(blanked):
        end = blanked.find(b" ", at + size) if at + size < len(blanked) else len(blanked)
        end = len(blanked) if end < 0 else end
        yield blanked[at:end].split()
        at = end
