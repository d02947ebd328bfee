"""Groups of rows as a stream: many small groups at a time, and of a large one only its own rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def starts_of(batch: pa.RecordBatch, on: list[str], last: list | None) -> np.ndarray:
    """Rows of a batch that begin a group; ``last`` is the key of the row before the batch."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = last is None or last != [batch.column(c)[0].as_py() for c in on]
    for c in on:
        codes = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def tasks_of(rows: DataFrame) -> int:
    """Tasks for rows whose work is far more than their bytes: a number given is kept, while shuffles of few bytes are joined into one task."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_groups(rows: DataFrame, on: list[str], order: list[str | Column], kernel: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str, tasks: int | None = None) -> DataFrame:
    """``kernel(table, bounds)`` over rows in the order of ``on`` and ``order``, of which group ``k`` lies between two bounds; with ``tasks`` in so many, however few the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bounds, size, last = [], [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            starts = starts_of(b, on, last)
            last = [b.column(c)[b.num_rows - 1].as_py() for c in on]
            if len(starts) and size + starts[-1]:
                cut = int(starts[-1])
                table = pa.Table.from_batches([*held, b.slice(0, cut)])
                held.clear()
                yield kernel(table, np.array([*bounds, *(size + starts).tolist()]))
                held, bounds, size = [b.slice(cut)], [0], b.num_rows - cut
            else:
                bounds += (size + starts).tolist()
                held.append(b)
                size += b.num_rows
        if held:
            table = pa.Table.from_batches(held)
            held.clear()
            yield kernel(table, np.array([*bounds, size]))

    return rows.repartition(*[tasks] * (tasks is not None), *on).sortWithinPartitions(*on, *order).mapInArrow(run, schema)
