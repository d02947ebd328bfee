"""Projections, predicates, orders and annotations of alignments. Rows come with identity and bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how much of the longer side may overhang at a sequence's end.
OVERHANG = 0.05


def selected(rows: DataFrame, identity: float = 0.0, length: int = 0, both: bool = False) -> DataFrame:
    """At least so much identity and length; ``both``: a row goes if either side is short, else only if both are."""
    one, two = F.abs(F.col("e1") - F.col("s1")) + 1, F.abs(F.col("e2") - F.col("s2")) + 1
    long = (F.least(one, two) if both else F.greatest(one, two)) >= length
    return rows.filter((F.col("idy") >= identity) & long)


def shown_percent(value: Column, exact: Column) -> Column:
    """Two decimals; neither 100 nor 0 unless that is exact."""
    clamped = F.when((value > 99.99) & ~exact, F.lit(99.99)).when((value < 0.01) & (value > 0), F.lit(0.01)).otherwise(value)
    return two_decimals(clamped)


def two_decimals(value: Column) -> Column:
    """Half up, by the same double operations in any engine."""
    return F.floor(value * 100 + 0.5) / 100


def coords(rows: DataFrame, protein: bool = False, coverage: bool = False, lengths: bool = False, directions: bool = False) -> DataFrame:
    """The table of coordinates, lengths and percentages, with the optional columns that are asked for."""
    one, two = F.abs(F.col("e1") - F.col("s1")) + 1, F.abs(F.col("e2") - F.col("s2")) + 1
    out = [F.col(c) for c in ("aln_id", "s1", "e1", "s2", "e2")] + [one.alias("len1"), two.alias("len2"), shown_percent(F.col("idy"), F.col("errors") == 0).alias("idy")]
    if protein:
        out += [shown_percent(F.col("sim"), F.col("sim_errors") == 0).alias("sim"), two_decimals(F.col("stp")).alias("stp")]
    if lengths:
        out += [F.col("ref_len"), F.col("qry_len")]
    if coverage:
        out += [two_decimals(one * 100.0 / F.col("ref_len")).alias("cov1"), two_decimals(two * 100.0 / F.col("qry_len")).alias("cov2")]
    if directions:
        out += [frame(protein, "1").alias("frm1"), frame(protein, "2").alias("frm2")]
    return rows.select(*out, "ref_id", "qry_id")


def frame(protein: bool, side: str) -> Column:
    """Direction, or the reading frame (1 to 3, negative on the reverse strand) for protein alignments."""
    start, length, way = F.col(f"s{side}"), F.col("ref_len" if side == "1" else "qry_len"), F.col(f"dir{side}")
    if not protein:
        return way
    return F.when(way > 0, F.pmod(start + 2, F.lit(3)) + 1).otherwise(-(F.pmod(length - start, F.lit(3)) + 1)).cast("int")


def ordered(rows: DataFrame, by: str | None = None) -> DataFrame:
    """By reference or query position; otherwise as the rows came in."""
    keys = {"reference": ["ref_id", "lo1", "qry_id", "lo2"], "query": ["qry_id", "lo2", "ref_id", "lo1"], None: []}[by]
    return rows.orderBy(*keys, "aln_id")


def overlap_annotation(rows: DataFrame) -> DataFrame:
    """``annot``: how the two sequences lie to each other, where an alignment reaches their ends."""
    apart = F.col("dir1") != F.col("dir2")
    lo1, hi1 = F.col("lo1"), F.col("hi1")
    lo2 = F.when(apart, F.col("qry_len") - F.col("hi2") + 1).otherwise(F.col("lo2"))
    hi2 = F.when(apart, F.col("qry_len") - F.col("lo2") + 1).otherwise(F.col("hi2"))
    hang = F.floor(OVERHANG * (F.greatest(hi1 - lo1, hi2 - lo2) + 1))
    b1, b2, e1, e2 = lo1 <= hang, lo2 <= hang, hi1 + hang > F.col("ref_len"), hi2 + hang > F.col("qry_len")
    kind = F.when(b1 & b2 & e1 & e2, "[IDENTITY]").when(b1 & e1, "[CONTAINED]").when(b2 & e2, "[CONTAINS]").when(b2, "[END]").otherwise("[BEGIN]")
    return rows.withColumn("annot", F.when((b1 | b2) & (e1 | e2), kind).otherwise(""))


def conflict_annotation(rows: DataFrame) -> DataFrame:
    """``annot``: how an alignment conflicts with the one before it of the same pair, in reference order."""
    before = Window.partitionBy("ref_id", "qry_id").orderBy("lo1", "lo2", "aln_id")
    p = {c: F.lag(c).over(before) for c in ("lo1", "hi1", "lo2", "hi2")}
    rows = rows.withColumns({f"_{c}": x for c, x in p.items()})
    lo1, hi1, lo2, hi2 = (F.col(c) for c in ("lo1", "hi1", "lo2", "hi2"))
    a1, z1, a2, z2 = (F.col(c) for c in ("_lo1", "_hi1", "_lo2", "_hi2"))
    same = (lo1 == a1) & (lo2 == a2) & (hi1 == z1) & (hi2 == z2)
    around = (lo1 < a1) & (lo2 < a2) & (hi1 > z1) & (hi2 > z2)
    inside = (a1 < lo1) & (a2 < lo2) & (z1 > hi1) & (z2 > hi2)
    touch = lo1.between(a1, z1) | hi1.between(a1, z1) | lo2.between(a2, z2) | hi2.between(a2, z2)
    kind = F.when(same, "[DUPLICATE]").when(around, "[CONTAINS]").when(inside, "[SHADOWED]").when(touch, "[OVERLAPS]")
    return rows.withColumn("annot", F.coalesce(F.when(a1.isNotNull(), kind), F.lit(""))).drop("_lo1", "_hi1", "_lo2", "_hi2")


#: Stretches that are walked together.
RUNS = 4096


def _runs(rows: DataFrame) -> DataFrame:
    """Add ``_run``: numbers of groups of ``RUNS`` stretches of a pair's alignments that no alignment crosses on the reference; what is decided inside one touches no other."""
    step = Window.partitionBy("ref_id", "qry_id").orderBy("lo1", "lo2", "aln_id")
    reach = F.max("hi1").over(step.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("lo1") > reach).cast("int"), F.lit(1)))
    return rows.withColumn("_run", F.floor(F.sum("_new").over(step.rowsBetween(Window.unboundedPreceding, 0)) / RUNS)).drop("_new")


def merged(rows: DataFrame) -> DataFrame:
    """Brief form: in reference order, each box of a pair takes in the later ones that overlap it, as grown so far, on both sides; directions don't matter."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lo1", "lo2", "aln_id"], kind="stable")
        boxes = part[["lo1", "hi1", "lo2", "hi2"]].to_numpy(np.int64)
        gone, out = np.zeros(len(boxes), bool), []
        for i in range(len(boxes)):
            if gone[i]:
                continue
            a1, z1, a2, z2 = boxes[i]
            n = 1
            for j in range(i + 1, len(boxes)):
                if boxes[j, 0] > z1:
                    break
                if not gone[j] and boxes[j, 2] <= z2 and boxes[j, 3] >= a2:
                    z1, a2, z2 = max(z1, boxes[j, 1]), min(a2, boxes[j, 2]), max(z2, boxes[j, 3])
                    gone[j], n = True, n + 1
            out.append((part.ref_id.iloc[0], part.qry_id.iloc[0], a1, z1, a2, z2, n))
        return pd.DataFrame(out, columns=["ref_id", "qry_id", "lo1", "hi1", "lo2", "hi2", "merged"])

    slim = _runs(rows).select("ref_id", "qry_id", "_run", "aln_id", "lo1", "hi1", "lo2", "hi2")
    return slim.groupBy("ref_id", "qry_id", "_run").applyInPandas(run, "ref_id string, qry_id string, lo1 long, hi1 long, lo2 long, hi2 long, merged long")


#: The share of the shorter that two alignments must overlap on both sides to be rivals, and how long the better one must be against the other.
RIVAL_OVERLAP, RIVAL_LENGTH = 0.5, 0.75


def knockout(rows: DataFrame) -> DataFrame:
    """Without alignments that lose to a rival of the same strand.

    Rivals overlap on both sides by at least half of the shorter. In reference order, an alignment
    that is more similar than a later rival and at least three quarters as long on both sides knocks it
    out, and otherwise is knocked out itself; who is out takes no further part.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lo1", "lo2", "aln_id"], kind="stable")
        lo1, hi1, lo2, hi2, sim, way = (part[c].to_numpy() for c in ("lo1", "hi1", "lo2", "hi2", "sim", "way"))
        one, two, out = hi1 - lo1 + 1, hi2 - lo2 + 1, np.zeros(len(part), bool)
        for i in range(len(part)):
            if out[i]:
                continue
            j = np.arange(i + 1, np.searchsorted(lo1, hi1[i], "right"))
            j = j[~out[j] & (way[j] == way[i])]
            over1, over2 = hi1[i] - lo1[j] + 1, np.minimum(hi2[i], hi2[j]) - np.maximum(lo2[i], lo2[j]) + 1
            j = j[(over1 >= RIVAL_OVERLAP * np.minimum(one[i], one[j])) & (over2 >= RIVAL_OVERLAP * np.minimum(two[i], two[j]))]
            wins = (sim[i] > sim[j]) & (one[i] >= RIVAL_LENGTH * one[j]) & (two[i] >= RIVAL_LENGTH * two[j])
            lost = np.flatnonzero(~wins)
            out[j[: lost[0]] if len(lost) else j] = True
            out[i] = len(lost) > 0
        return pd.DataFrame({"aln_id": part.aln_id, "_out": out})

    slim = _runs(rows).select("ref_id", "qry_id", "_run", "aln_id", "lo1", "hi1", "lo2", "hi2", "sim", (F.col("dir1") * F.col("dir2")).alias("way"))
    kept = slim.groupBy("ref_id", "qry_id", "_run").applyInPandas(run, "aln_id long, _out boolean").filter("NOT _out").select("aln_id")
    return rows.join(kept, "aln_id", "left_semi")


def listed(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The alignments that ``lines`` (``value``) name by their ends and sequences; a line that names none fails the job, and so does one that is none.

    A line holds start and end on the reference, a bar or none, start and end on the query, and, last,
    the two sequences. What stands between is ignored, empty lines too, and a line twice counts once. Of equal
    alignments the one of the least id is named.
    """
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    words = F.when(F.get(words, F.lit(2)) == "|", F.concat(F.slice(words, 1, 2), F.slice(words, 4, 1_000_000))).otherwise(words)
    cells = lines.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select("value", words.alias("w"))
    ends = ["s1", "e1", "s2", "e2"]
    whole = F.size("w") >= 6
    for k in range(4):
        whole = whole & F.get("w", F.lit(k)).rlike("^[0-9]+$")
    key = [*ends, "ref_id", "qry_id"]
    named = cells.withColumn("w", F.when(whole, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("no line of an alignment: "), "value")).cast("array<string>")))
    named = named.select(*(F.col("w")[k].cast("long").alias(c) for k, c in enumerate(ends)), F.element_at("w", -2).alias("ref_id"), F.element_at("w", -1).alias("qry_id")).distinct()
    first = rows.groupBy(*key).agg(F.min("aln_id").alias("aln_id"))
    met = named.join(first, key, "left")
    missing = F.raise_error(F.concat(F.lit("no such alignment: "), F.concat_ws(" ", *key))).cast("long")
    return rows.join(met.select(F.coalesce("aln_id", missing).alias("aln_id")), "aln_id", "left_semi")
