"""Structural differences: a walk along each sequence over its best alignments, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def breakpoints(rows: DataFrame, side: str = "reference") -> DataFrame:
    """``seq_id, type, start, end, len, len2, diff, prev_seq, next_seq``.

    ``rows`` have bounds and the flags ``is_r`` and ``is_q`` of the best chains. Along the
    reference, rows of its own chain are walked from low to high; what lies between a row and the
    one before is classified by the row before (any) and the row before that is in both chains:
    at the sequence's end BRK; same pair with another direction INV, not next in order JMP, next
    with nothing between GAP, else BRK; not in the other chain BRK and DUP; after another sequence
    SEQ, else BRK. BRK rows without length are left out. ``side="query"`` mirrors it.
    """
    a, b, mine, other, seq, mate, length = ("1", "2", "is_r", "is_q", "ref_id", "qry_id", "ref_len") if side == "reference" else ("2", "1", "is_q", "is_r", "qry_id", "ref_id", "qry_len")
    walk = rows.filter(mine).select(F.col(seq).alias("seq_id"), F.col(mate).alias("mate"), F.col(f"lo{a}").alias("lo"), F.col(f"hi{a}").alias("hi"), F.col(f"lo{b}").alias("mlo"), F.col(f"hi{b}").alias("mhi"), (F.col("dir1") * F.col("dir2")).alias("slope"), F.col(other).alias("both"), F.col(length).alias("length"), "aln_id")
    rank = Window.partitionBy("seq_id", "mate").orderBy("mlo", "mhi", "aln_id")
    ranked = walk.filter("both").withColumn("rank", F.row_number().over(rank))
    walk = ranked.unionByName(walk.filter("NOT both").withColumn("rank", F.lit(None).cast("int")))
    ends = rows.groupBy(F.col(seq).alias("seq_id")).agg(F.max(length).alias("length"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("mate", "string"), ("mlo", "long"), ("mhi", "long"), ("slope", "int"))]
    right = ends.select("seq_id", *none, (F.col("length") + 1).alias("lo"), (F.col("length") + 1).alias("hi"), F.lit(True).alias("both"), "length", F.lit(None).cast("long").alias("aln_id"), F.lit(None).cast("int").alias("rank"))
    left = right.withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.lit(0).cast("long"))
    padded = walk.withColumn("pad", F.lit(1)).unionByName(left.withColumn("pad", F.lit(0))).unionByName(right.withColumn("pad", F.lit(2)))
    order = Window.partitionBy("seq_id").orderBy("pad", "lo", "hi", "aln_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("both"), F.struct("mate", "slope", "rank", "mlo", "mhi", "hi", "aln_id"))
    seen = padded.withColumn("pa_hi", F.lag("hi").over(order)).withColumn("pa_id", F.lag("aln_id").over(order)).withColumn("pg", F.last(good, True).over(past)).filter("pad > 0")
    same = F.col("pg.mate") == F.col("mate")
    nothing = F.col("pa_id").eqNullSafe(F.col("pg.aln_id"))
    kind = (
        F.when(F.col("pad") == 2, "BRK")
        .when(~F.col("both"), "DUP")
        .when(same & (F.col("slope") != F.col("pg.slope")), "INV")
        .when(same & (F.col("rank") != F.col("pg.rank") + F.col("pg.slope")), "JMP")
        .when(same & nothing, "GAP")
        .when(same, "BRK")
        .when(F.col("pg.mate").isNotNull(), "SEQ")
        .otherwise("BRK")
    )
    start, end = F.col("pa_hi") + 1, F.col("lo") - 1
    between = F.when(F.col("slope") > 0, F.col("mlo") - F.col("pg.mhi") - 1).otherwise(F.col("pg.mlo") - F.col("mhi") - 1)
    seen = seen.withColumn("kind", kind).withColumn("mgap", F.when(F.col("kind") == "GAP", between))
    first = F.struct(F.when(F.col("kind") == "DUP", "BRK").otherwise(F.col("kind")).alias("type"), start.alias("start"), end.alias("end"))
    copy = F.struct(F.lit("DUP").alias("type"), F.col("lo").alias("start"), F.col("hi").alias("end"))
    found = seen.withColumn("f", F.explode(F.when(F.col("kind") == "DUP", F.array(first, copy)).otherwise(F.array(first))))
    span = F.col("f.end") - F.col("f.start") + 1
    out = found.select("seq_id", F.col("f.type").alias("type"), F.col("f.start").alias("start"), F.col("f.end").alias("end"), span.alias("len"), F.col("mgap").alias("len2"), (span - F.col("mgap")).alias("diff"), F.when(F.col("kind") == "SEQ", F.col("pg.mate")).alias("prev_seq"), F.when(F.col("kind") == "SEQ", F.col("mate")).alias("next_seq"))
    return out.filter("type != 'BRK' OR len > 0")


def gaps_between(rows: DataFrame) -> DataFrame:
    """Add ``gap1, gap2``: what lies between a match and the one before it in its cluster."""
    step = Window.partitionBy("cluster_id").orderBy("ord")
    return rows.withColumn("gap1", F.col("s1") - F.lag(F.col("s1") + F.col("len")).over(step)).withColumn("gap2", F.col("s2") - F.lag(F.col("s2") + F.col("len")).over(step))


def offsets(seqs: DataFrame) -> DataFrame:
    """Add ``offset``: where each sequence of a set begins when they are laid end to end in ``ord``.

    Sets are numbered in slices of ``ord`` whose totals are summed apart, so no set meets in one task.
    """
    sliced = seqs.withColumn("_slice", F.floor(F.col("ord") / 4096))
    totals = sliced.groupBy("seq_set", "_slice").agg(F.sum(F.col("len") - 1).alias("_n"))
    before = Window.partitionBy("seq_set").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("seq_set", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("seq_set", "_slice").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = sliced.withColumn("_in", F.coalesce(F.sum(F.col("len") - 1).over(inside), F.lit(0)))
    return rows.join(starts, ["seq_set", "_slice"]).withColumn("offset", F.col("_start") + F.col("_in")).drop("_slice", "_start", "_in")
