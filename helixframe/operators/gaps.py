"""What lies between matches, by edit distance, and regions made of clusters with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.groups import tasks_of


def gap_errors(one: str, two: str, limit: int | None = 10_000) -> int | None:
    """Least cost of turning one into the other: one for a base changed or in a gap, and one for each gap; None if either is too long.

    Without a ``limit`` long stretches are told too, by the furthest places that each cost can reach: memory
    grows with their letters, time with letters and cost.
    """
    if limit is not None and max(len(one), len(two)) >= limit:
        return None
    a, b = np.frombuffer(one.encode("utf-32-le"), np.uint32), np.frombuffer(two.encode("utf-32-le"), np.uint32)
    n, m = len(a), len(b)
    if not n or not m:
        return (n or m) + 1 if n or m else 0
    if max(n, m) >= 1000:
        return _least_cost(a, b)
    far = 1 << 40
    places = np.arange(m + 1)
    pair = np.where(places == 0, 0, far)
    up = np.full(m + 1, far)
    across = np.where(places == 0, far, places + 1)
    best = np.minimum(pair, across)
    for i in range(1, n + 1):
        up = np.minimum(up + 1, best + 2)
        pair = np.concatenate([[far], best[:-1] + (a[i - 1] != b)])
        stem = np.minimum(pair, up)
        # a gap in this row: the least of stem[k] + 1 + (j - k) over k < j
        least = np.minimum.accumulate(stem - places)
        across = np.concatenate([[far], least[:-1] + places[1:] + 1])
        best = np.minimum(stem, across)
    return int(best[m])


def _least_cost(a: np.ndarray, b: np.ndarray) -> int:
    """The cost of ``gap_errors``, found cost by cost.

    ``any_[d]`` is how far into ``a`` a cost gets on diagonal ``d`` (letters of ``b`` less those of ``a``),
    ``right`` and ``down`` the same where the end is a gap in ``a`` or in ``b``. A changed letter leads on from the cost
    one less, a longer gap too, and a new gap from the cost two less; equal letters then cost nothing.
    """
    n, m = len(a), len(b)
    zero, low = n + 1, -(1 << 40)  # diagonal 0 is at ``zero``, with a place to spare on both sides
    blank = np.full(n + m + 3, low)
    end_a, end_b = np.append(a, np.uint32(0xFFFFFFFE)), np.append(b, np.uint32(0xFFFFFFFF))
    step = np.arange(32)

    def slide(at: np.ndarray, lo: int) -> None:
        moving = np.flatnonzero(at >= 0)
        while len(moving):
            i = at[moving, None] + step
            j = i + (moving + lo - zero)[:, None]
            differs = end_a[np.minimum(i, n)] != end_b[np.minimum(j, m)]
            run = np.where(differs.any(axis=1), differs.argmax(axis=1), len(step))
            at[moving] += run
            moving = moving[run == len(step)]

    older, last = blank.copy(), blank.copy()
    last[zero] = 0
    slide(last[zero : zero + 1], zero)
    right, down, cost = blank.copy(), blank.copy(), 0
    while last[zero + m - n] < n:
        cost += 1
        lo, hi = max(1, zero - cost), min(n + m + 1, zero + cost) + 1
        reach = np.minimum(n, m - (np.arange(lo, hi) - zero))  # no place beyond either end
        inside = lambda x: np.where(x > reach, low, x)  # noqa: B023, E731
        new_right = inside(np.maximum(older[lo - 1 : hi - 1], right[lo - 1 : hi - 1]))
        new_down = inside(np.maximum(older[lo + 1 : hi + 1], down[lo + 1 : hi + 1]) + 1)
        best = np.maximum(np.maximum(inside(last[lo:hi] + 1), new_right), new_down)
        slide(best, lo)
        older, last = last, older
        last[lo:hi], right[lo:hi], down[lo:hi] = best, new_right, new_down
    return cost


def annotate(chained: DataFrame, refs: DataFrame, queries: DataFrame, limit: int | None = 10_000) -> DataFrame:
    """Add ``gap1, gap2, gap_errors``: what lies between a match and the one before it in its cluster, and its edit distance (null from ``limit`` letters on)."""
    order = Window.partitionBy("ref_id", "qry_id", "strand", "cluster_id").orderBy("ord")
    rows = chained.withColumn("_e1", F.lag(F.col("s1") + F.col("len")).over(order)).withColumn("_e2", F.lag(F.col("s2") + F.col("len")).over(order))
    rows = rows.withColumn("gap1", F.col("s1") - F.col("_e1")).withColumn("gap2", F.col("s2") - F.col("_e2"))
    between = lambda seq, start, gap: F.when(F.col(gap) > 0, F.substring(seq, F.col(start).cast("int"), F.col(gap).cast("int"))).otherwise("")
    # what lies between is cut out of one sequence before the other is met
    rows = rows.join(refs.select(F.col("seq_id").alias("ref_id"), F.col("seq").alias("_r")), "ref_id").withColumn("_a", between(F.col("_r"), "_e1", "gap1")).drop("_r", "_e1")
    rows = rows.join(queries.select(F.col("seq_id").alias("qry_id"), F.col("seq").alias("_f")), "qry_id")
    turned = F.when(F.col("strand") < 0, F.reverse(F.translate("_f", "acgt", "tgca"))).otherwise(F.col("_f"))
    rows = rows.withColumn("_b", between(turned, "_e2", "gap2")).drop("_f", "_e2")
    schema = rows.drop("_a", "_b").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [None if g is None else gap_errors(x or "", y or "", limit) for g, x, y in zip(b.column("gap1").to_pylist(), b.column("_a").to_pylist(), b.column("_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c.name) for c in schema], pa.array(known, pa.int64())], names=[*schema.names, "gap_errors"])

    dealt = rows.repartition(tasks_of(rows), "ref_id", "qry_id", "strand", "cluster_id", "ord")
    return dealt.mapInArrow(run, ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in schema) + ", gap_errors long")


def regions(annotated: DataFrame) -> DataFrame:
    """One row a cluster: its ends, its errors and their rate over the longer side; both are null where a gap is too long to be aligned."""
    on = ["ref_id", "qry_id", "strand", "cluster_id"]
    rows = annotated.groupBy(*on).agg(F.min("s1").alias("lo1"), F.max(F.col("s1") + F.col("len") - 1).alias("hi1"), F.min("s2").alias("lo2"), F.max(F.col("s2") + F.col("len") - 1).alias("hi2"), F.when(F.sum(F.when(F.col("gap1").isNotNull() & F.col("gap_errors").isNull(), 1)).isNull(), F.coalesce(F.sum("gap_errors"), F.lit(0))).alias("errors"))
    return rows.withColumn("rate", F.col("errors") / F.greatest(F.col("hi1") - F.col("lo1") + 1, F.col("hi2") - F.col("lo2") + 1))
