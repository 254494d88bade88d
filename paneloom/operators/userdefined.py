"""User-defined aggregates with a state of their own, and user-defined table functions over partitions.

An aggregate is a zero, a step, a merge and an end, in plain Python. Each task steps through its rows with a state for each
group and emits the states, so that what is shuffled is a state for each group and task, and a hot group is stepped by all
tasks. States of a group are merged in two rounds, first in `PARTS` parts and then those; a task holds one merged state at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tasks among which a group's states are dealt to be merged, and groups whose states a task holds before it emits them.
PARTS, HELD_GROUPS = 64, 100_000


@dataclass(frozen=True)
class Aggregate:
    """`step(state, row)` takes a dict of the columns and gives the next state; `merge` joins two states; `end` gives a dict of the
    result's columns. States can be any values that pickle."""

    zero: Callable[[], Any]
    step: Callable[[Any, dict], Any]
    merge: Callable[[Any, Any], Any]
    end: Callable[[Any], dict]


def _keyed(b: pa.RecordBatch, by: Sequence[str]) -> list[tuple]:
    return list(zip(*(b.column(k).to_pylist() for k in by), strict=True)) if by else [()] * len(b)


def aggregate(df: DataFrame, by: Sequence[str], columns: Sequence[str], agg: Aggregate, schema: str, *, parts: int = PARTS, held_groups: int = HELD_GROUPS) -> DataFrame:
    """A row for each group (or one): by, and the columns of `schema`. Without groups an empty table gives the zero's end."""
    result = T.StructType.fromDDL(schema)
    keys = [df.schema[k] for k in by]
    packed = T.StructType([*keys, T.StructField("_task", T.LongType()), T.StructField("_state", T.BinaryType())])

    def rows_of(states: dict, own: int) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([pa.field(k.name, arrow[k.name]) for k in keys] + [("_task", pa.int64()), ("_state", pa.binary())])
        items = list(states.items())
        for at in range(0, len(items), 1000):
            some = items[at : at + 1000]
            columns_ = [pa.array([k[i] for k, _ in some], kinds.field(i).type) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns_, pa.array([own] * len(some), pa.int64()), pa.array([pickle.dumps(s) for _, s in some], pa.binary())], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = {k.name: to_arrow_type(k.dataType) for k in keys}
    arrow_result = [(f.name, to_arrow_type(f.dataType)) for f in result]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        states: dict = {}
        for b in batches:
            given = zip(*(b.column(c).to_pylist() for c in columns), strict=True) if columns else iter([()] * len(b))
            for key, row in zip(_keyed(b, by), given, strict=True):
                state = states[key] if key in states else agg.zero()
                states[key] = agg.step(state, dict(zip(columns, row, strict=True)))
            if len(states) > held_groups:
                yield from rows_of(states, own)
                states.clear()
        yield from rows_of(states, own)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of group: one state for each run."""
        now, state, own, out = None, None, 0, {}
        for b in batches:
            for key, task, s in zip(_keyed(b, by), b.column("_task").to_pylist(), b.column("_state").to_pylist(), strict=True):
                new = pickle.loads(s)
                if key == now:
                    state = agg.merge(state, new)
                    continue
                if now is not None:
                    out[now] = state
                    if len(out) >= 1000:
                        yield from rows_of(out, own)
                        out.clear()
                now, state, own = key, new, task
        if now is not None:
            out[now] = state
        yield from rows_of(out, own)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [agg.end(pickle.loads(s)) for s in b.column("_state").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in by), *(pa.array([f[n] for f in found], t) for n, t in arrow_result)], [*by, *(n for n, _ in arrow_result)])

    used = list(dict.fromkeys([*by, *columns]))
    states = df.select(*used).mapInArrow(partial, packed) if used else df.select(F.lit(1).alias("_one")).mapInArrow(partial, packed)
    group = [F.col(k) for k in by]
    part = F.pmod(F.xxhash64("_task"), F.lit(parts))
    states = states.repartition(*group, part).sortWithinPartitions(*group, "_task").mapInArrow(merged, packed)
    last = states.repartition(*group) if by else states.repartition(1)
    last = last.sortWithinPartitions(*group) if by else last
    out = last.mapInArrow(merged, packed).mapInArrow(ended, T.StructType([*keys, *result]))
    if by:
        return out
    zero = df.sparkSession.createDataFrame([tuple(agg.end(agg.zero())[f.name] for f in result)], result)
    return out.select("*", F.lit(0).alias("_o")).unionByName(zero.select("*", F.lit(1).alias("_o"))).orderBy("_o").limit(1).drop("_o")


def table_function(handler: type, schema: str) -> Callable[..., DataFrame]:
    """A class with `eval(row)` (and `terminate()`) as a function of a table: called with a DataFrame, the columns by which it is
    parted and their order, it gives the rows that the class yields, one instance for each part."""
    from pyspark.sql.functions import udtf

    made = udtf(handler, returnType=schema)

    def call(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
        if not partition_by:
            raise ValueError("a table function takes a table in parts; without any all rows would meet in one task")
        given = df.asTable().partitionBy(*partition_by)
        return made(given.orderBy(*order_by) if order_by else given)

    return call
