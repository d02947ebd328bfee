"""Coverage by intervals: sweeps over their ends, never over positions and never row against row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.groups import tasks_of


def _dealt(rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows in a fixed number of tasks: sorted rows take many times the bytes of their shuffle, by which else so many would be joined into one task."""
    return rows.repartition(4 * tasks_of(rows), *on)


def union(rows: DataFrame, on: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``lo, hi, members`` of the runs of overlapping or touching intervals within ``on``."""
    step = Window.partitionBy(*on).orderBy(lo, hi)
    reach = F.max(hi).over(step.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.select(*on, lo, hi, F.coalesce((reach + 1 < F.col(lo)).cast("int"), F.lit(1)).alias("_new"))
    runs = new.withColumn("_run", F.sum("_new").over(step.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*on, "_run").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("members")).drop("_run")


def covered(rows: DataFrame, on: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Covered positions within each of ``on``."""
    return union(rows, on, lo, hi).groupBy(*on).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("covered"), F.count(F.lit(1)).alias("runs"))


def depth(rows: DataFrame, on: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``lo, hi, depth`` of the stretches of equal coverage, above zero."""
    ends = rows.select(*on, F.explode(F.array(F.struct(F.col(lo).alias("at"), F.lit(1).alias("step")), F.struct((F.col(hi) + 1).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = _dealt(ends, on).groupBy(*on, F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    order = Window.partitionBy(*on).orderBy("at")
    run = steps.withColumn("depth", F.sum("step").over(order)).withColumn("next", F.lead("at").over(order))
    return run.filter("depth > 0").select(*on, F.col("at").alias("lo"), (F.col("next") - 1).alias("hi"), "depth")


def unique_share(rows: DataFrame, on: list[str], lo: str, hi: str, key: str = "aln_id") -> DataFrame:
    """Add ``unique``: how many of an interval's positions no other interval of ``on`` covers.

    Positions of depth one are counted by a running sum over the sweep, which each interval reads at its two ends.
    """
    kept = rows.columns
    single = depth(rows, on, lo, hi).filter("depth = 1")
    marks = single.select(*on, F.col("lo").alias("at"), F.lit(0).alias("kind"), "lo", (F.col("hi") - F.col("lo") + 1).alias("n"), F.lit(None).cast("long").alias("_id"))
    keyed = rows.withColumn("_id", F.col(key))
    asks = keyed.select(*on, F.col(lo).alias("a"), (F.col(hi) + 1).alias("z"), "_id")
    none = F.lit(None).cast("long")
    asks = asks.select(*on, F.col("a").alias("at"), F.lit(1).alias("kind"), none.alias("lo"), none.alias("n"), "_id").unionByName(asks.select(*on, F.col("z").alias("at"), F.lit(2).alias("kind"), none.alias("lo"), none.alias("n"), "_id"))
    order = Window.partitionBy(*on).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    # positions of depth one before ``at``: the stretches that began before it, less what of the last one lies beyond
    swept = _dealt(marks.unionByName(asks), on).withColumn("_sum", F.sum("n").over(order)).withColumn("_lo", F.last("lo", True).over(order)).withColumn("_n", F.last("n", True).over(order))
    before = F.coalesce(F.col("_sum") - F.greatest(F.lit(0), F.col("_lo") + F.col("_n") - F.col("at")), F.lit(0))
    counted = _dealt(swept.filter("kind > 0").select("_id", (before * F.when(F.col("kind") == 2, 1).otherwise(-1)).alias("c")), ["_id"]).groupBy("_id").agg(F.sum("c").alias("unique"))
    return _dealt(keyed, ["_id"]).join(counted, "_id").select(*kept, "unique")


def at_positions(points: DataFrame, rows: DataFrame, on: list[str], at: str, lo: str, hi: str, name: str) -> DataFrame:
    """Add ``name``: how many intervals of ``on`` cover the position ``at`` of each point."""
    ends = rows.select(*on, F.explode(F.array(F.struct(F.col(lo).alias("_at"), F.lit(1).cast("long").alias("_step")), F.struct((F.col(hi) + 1).alias("_at"), F.lit(-1).cast("long").alias("_step")))).alias("e"))
    ends = ends.select(*on, "e._at", "e._step")  # at one place they come before the points
    both = points.select("*", F.col(at).alias("_at"), F.lit(0).cast("long").alias("_step"), F.lit(1).alias("_kind")).unionByName(ends.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*on).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return _dealt(both, on).withColumn(name, F.sum("_step").over(order)).filter("_kind = 1").drop("_at", "_step", "_kind")
