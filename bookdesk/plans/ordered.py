"""Scans over rows in key order that hand a state from one partition to the next.

A window per key puts all rows of a key into one task. Here rows are dealt by ranges
of (key, order) instead, so a key of any size spreads over consecutive partitions,
and what the rows before a partition mean for it is a small *carried state*:

1. ``in_order`` deals and sorts the rows, and checkpoints them (reliable, in the
   session's shared folder), since every pass must see the same ranges.
2. One pass makes a summary per partition; the summaries (one small value a
   partition, whose number the shuffle setting bounds) are folded in order on the driver.
3. The next pass starts each partition with its carried state.

Both passes are Arrow batches in numpy; a partition is read as a stream.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from ..session import cut_lineage, workers_find_package

#: (batches of one partition) -> its summary, small and picklable
Summary = Callable[[Iterator], Any]


def in_order(df: DataFrame, *by: str | Column, parts: int | None = None) -> DataFrame:
    """The rows dealt by ranges of ``by`` (``parts`` of them, else as the session says)
    and sorted by it, checkpointed."""
    workers_find_package(df.sparkSession)
    return cut_lineage(df.repartitionByRange(*(() if parts is None else (parts,)), *by).sortWithinPartitions(*by))


def summaries(ordered: DataFrame, summary: Summary) -> list:
    """The summary of each partition that has rows, as (partition, summary) in order."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        seen = []

        def counted():
            for b in batches:
                seen.append(b.num_rows)
                yield b

        value = summary(filter(lambda b: b.num_rows, counted()))
        if sum(seen):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              pa.array([pickle.dumps(value)], pa.binary())], ["part", "value"])

    rows = ordered.mapInArrow(run, "part int, value binary").collect()
    return sorted((r["part"], pickle.loads(bytes(r["value"]))) for r in rows)


def scan(ordered: DataFrame, carried: dict[int, Any], step: Callable[[Any, Iterator], Iterator], schema: str) -> DataFrame:
    """``step(carried state or None, batches)`` over every partition."""

    def run(batches: Iterator) -> Iterator:
        yield from step(carried.get(TaskContext.get().partitionId()), filter(lambda b: b.num_rows, batches))

    return ordered.mapInArrow(run, schema)


def starts_of(key, before) -> np.ndarray:
    """Which rows of a batch begin a new key; ``before`` is the key of the row before the batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(key, pa.ChunkedArray):
        key = key.combine_chunks()
    same = pc.fill_null(pc.equal(key[1:], key[:-1]), False).to_numpy(zero_copy_only=False)
    return np.r_[before is None or key[0].as_py() != before, ~same]


def _of_last_key(key: str) -> Summary:
    """(first key, last key, rows of the last key) of a partition."""
    def run(batches: Iterator):
        first, last, n = None, None, 0
        for k, b in enumerate(batches):
            begin = np.flatnonzero(starts_of(b.column(key), last))
            first = b.column(key)[0].as_py() if k == 0 else first
            last = b.column(key)[-1].as_py()
            n = b.num_rows - int(begin[-1]) if len(begin) else n + b.num_rows
        return first, last, n
    return run


def positions(df: DataFrame, key: str, *order: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``, the place (from 1) of each row among those of its ``key`` in ``order``,
    which must be total. Rows come out in order of (key, order); a key of any size spreads
    over partitions. Rows without a key are each the first of their own."""
    import pyarrow as pa

    ordered = in_order(df, key, *order, parts=parts)
    carried, now = {}, None
    for part, (first, last, n) in summaries(ordered, _of_last_key(key)):
        carried[part] = now
        now = (last, n + now[1] if now is not None and first == last == now[0] else n)
    cols = df.columns

    def step(before, batches: Iterator) -> Iterator:
        last, n = before or (None, 0)
        for b in batches:
            starts = starts_of(b.column(key), last)
            at = np.arange(b.num_rows)
            begin = np.maximum.accumulate(np.where(starts, at, -1))
            place = at - begin + np.where(begin < 0, n, 1)
            last, n = b.column(key)[-1].as_py(), int(place[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(place, pa.int32())], [*cols, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return scan(ordered, carried, step, f"{schema}, `{name}` int")
