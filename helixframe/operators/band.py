"""Clusters of one pair's matches by many tasks: repeats by their starts, the band join by tiles.

A pair of sequences is an area of places on the query and diagonals. It is cut into square tiles; a
match belongs to the tile that it starts in and visits the others that its reach touches. A link
lies in the tile where its later match starts, so each tile finds its own, and matches that were in several tiles
say which of the tiles' groups are one. Only those travel further, as links that are contracted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.deploy import written
from helixframe.operators import cluster
from helixframe.operators.components import components
from helixframe.operators.structure import offsets

PAIR = ["ref_id", "qry_id", "strand"]
CELLS = "ref_id string, qry_id string, strand int, s1 long, s2 long, len long, axis long"


def _with_axis(matches: DataFrame) -> DataFrame:
    """``axis``: where a match's reference begins on the axis that it is clustered on."""
    axis = F.col("axis") if "axis" in matches.columns else F.lit(0)
    return matches.select("ref_id", "qry_id", F.col("strand").cast("int").alias("strand"), *(F.col(c).cast("long").alias(c) for c in ("s1", "s2", "len")), axis.cast("long").alias("axis"))


def _in_groups(rows: DataFrame, on: list[str], order: list[str], kernel: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel(rows, bounds)`` over rows in the order of ``on`` and ``order``, of which group ``k`` lies between two bounds.

    A partition's groups come as a stream, many small ones at a time; only the one that goes on is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in batches:
            if not len(part):
                continue
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            new = np.zeros(len(part), bool)
            for c in on:
                new[1:] |= part[c].to_numpy()[1:] != part[c].to_numpy()[:-1]
            starts = np.append(0, np.flatnonzero(new))
            held = part.iloc[starts[-1] :].reset_index(drop=True)
            if len(starts) > 1:
                yield kernel(part.iloc[: starts[-1]].reset_index(drop=True), starts)
        if held is not None:
            yield kernel(held, np.array([0, len(held)]))

    return rows.repartition(*on).sortWithinPartitions(*on, *order).mapInPandas(run, schema)


def without_repeats(matches: DataFrame, on: list[str] = PAIR) -> DataFrame:
    """``thin`` of each ``on``, by windows over diagonals and by starts: ``ref_id, qry_id, strand, s1, s2, len, axis``.

    A lone match at its starts needs no rival's sight and never enters Python; one start's matches
    are one task's work, ``n log n`` in their number.
    """
    rows = _with_axis(matches).withColumn("_diagonal", F.col("s2") - F.col("s1"))
    # frames by place, not by row: matches of one start see the same reach and run, whichever of them a sort puts first
    line = Window.partitionBy(*on, "_diagonal").orderBy("s2")
    reach = F.max(F.col("s2") + F.col("len")).over(line.rangeBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("_begin", F.when(F.coalesce(F.col("s2") > reach, F.lit(True)), F.col("s2")))
    runs = runs.withColumn("_run", F.max("_begin").over(line.rangeBetween(Window.unboundedPreceding, 0)))
    single = runs.groupBy(*on, "_diagonal", "_run").agg(*([] if "ref_id" in on else [F.first("ref_id").alias("ref_id")]), F.min("s1").alias("s1"), F.min("s2").alias("s2"), (F.max(F.col("s2") + F.col("len")) - F.min("s2")).alias("len"), F.first("axis").alias("axis"))
    plain = [c.split()[0] for c in CELLS.split(", ")]
    alone = lambda start: F.count(F.lit(1)).over(Window.partitionBy(*on, start))
    counted = written(single.select(*plain).withColumn("_n1", alone("s1")).withColumn("_n2", alone("s2")), "starts")
    flags = "beaten boolean, before boolean, after boolean"

    def rivals(other: str):
        def run(part: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
            beaten, before, after = (np.zeros(len(part), bool) for _ in range(3))
            place, size, every = part[other].to_numpy(np.int64), part["len"].to_numpy(np.int64), np.arange(len(part))
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                cluster._rivals(place[a:z], size[a:z], every[a:z], every[a:z], beaten, before, after)
            return part[plain].assign(beaten=beaten, before=before, after=after)

        return run

    judged = [_in_groups(counted.filter(f"{n} > 1").select(*plain), [*on, start], [other], rivals(other), f"{CELLS}, {flags}") for n, start, other in (("_n1", "s1", "s2"), ("_n2", "s2", "s1"))]
    lone = counted.filter("_n1 = 1 AND _n2 = 1").select(*plain)
    verdict = judged[0].unionByName(judged[1]).groupBy(*plain).agg(*(F.max(c).alias(c) for c in ("beaten", "before", "after")))
    return lone.unionByName(verdict.filter("NOT beaten AND NOT (before AND after)").select(*plain))


def connected(matches: DataFrame, max_gap: int = 90, diagonal: int = 5, factor: float = 0.12, on: list[str] = PAIR, tile_bits: int = 14) -> DataFrame:
    """Add ``root_s1, root_s2``: the first match (by ``s2, s1``) that each is connected with among those of equal ``on``.

    Two matches are linked if the later starts at most ``max_gap`` after the earlier one's end and their
    diagonals differ by no more than ``diagonal`` or ``factor`` of what lies between. Matches of equal starts are
    told apart by nothing: one on each diagonal and place is expected, as ``without_repeats`` leaves them.
    """
    rows = _with_axis(matches)
    plain = rows.columns
    reach = max(int(diagonal), int(np.trunc(factor * max_gap)))
    place, end, line = F.col("s2"), F.col("s2") + F.col("len") + max_gap, F.col("s2") - F.col("s1")
    tile = lambda c: F.shiftright(c, tile_bits)
    dealt = rows.withColumn("_p", F.explode(F.sequence(tile(place), tile(end)))).withColumn("_q", F.explode(F.sequence(tile(line - reach), tile(line + reach))))
    dealt = dealt.withColumn("own", (F.col("_p") == tile(place)) & (F.col("_q") == tile(line)))
    travels = (tile(place) != tile(end)) | (tile(line - reach) != tile(line + reach))
    dealt = dealt.withColumn("travels", travels)

    def run(part: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        m, root = part[["s1", "s2", "len"]].to_numpy(np.int64), np.arange(len(part))
        for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
            a, z = bounds[k], bounds[k + 1]
            root[a:z] = a + cluster.connected(m[a:z], max_gap, diagonal, factor)
        return part[[*plain, "own", "travels"]].assign(root_s2=m[root, 1], root_s1=m[root, 0])

    grouped = _in_groups(dealt, [*on, "_p", "_q"], ["s2", "s1"], run, f"{CELLS}, own boolean, travels boolean, root_s2 long, root_s1 long")
    found = written(grouped, "tiles")
    node = lambda s2, s1: F.struct(*on, F.col(s2).alias("s2"), F.col(s1).alias("s1"))
    roots = components(found.filter("travels").select(node("s2", "s1").alias("a"), node("root_s2", "root_s1").alias("b")))
    own = found.filter("own").drop("own", "travels").withColumn("node", node("root_s2", "root_s1"))
    return own.join(roots, "node", "left").select(*plain, *(F.coalesce(f"root.{c}", f"root_{c}").alias(f"root_{c}") for c in ("s1", "s2")))


def clusters(matches: DataFrame, max_gap: int = 90, min_cluster: int = 65, diagonal: int = 5, factor: float = 0.12, by_extent: bool = False, refs: DataFrame | None = None, tile_bits: int = 14) -> DataFrame:
    """``cluster.clusters`` with a pair's matches in many tasks: a component is one task's work, not a pair.

    With ``refs`` (``seq_id, ord, seq``) the references lie end to end on one axis, one place between
    them: matches of different references rival and join each other, and a chain that passes from one
    to another is then cut where it does. The least length is asked of the whole chain, before the cut.
    """
    rows = _with_axis(matches)
    on = PAIR
    if refs is not None:
        on = ["qry_id", "strand"]
        # ``offsets`` leaves out a letter of each sequence, and one place lies between two
        laid = offsets(refs.select("seq_id", "ord", F.lit(0).alias("seq_set"), (F.length("seq") + 2).cast("long").alias("len")))
        rows = rows.drop("axis").join(laid.select(F.col("seq_id").alias("ref_id"), F.col("offset").alias("axis")), "ref_id").withColumn("s1", F.col("s1") + F.col("axis"))
    grouped = connected(without_repeats(rows, on), max_gap, diagonal, factor, on, tile_bits)
    if not by_extent:  # no chain of these is long enough
        grouped = grouped.withColumn("_sum", F.sum("len").over(Window.partitionBy(*on, "root_s2", "root_s1"))).filter(F.col("_sum") >= min_cluster).drop("_sum")

    def run(part: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        m = part[["s1", "s2", "len"]].to_numpy(np.int64)
        refs_, queries, strands, axes = (part[c].tolist() for c in ("ref_id", "qry_id", "strand", "axis"))
        cells = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = {(a, b): i for i, (a, b) in enumerate(m[lo:hi, :2].tolist(), lo)}
            for rows_ in cluster.peel(m[lo:hi], min_cluster, by_extent):
                head, last, n = None, None, 0
                for s1, s2, size, adj in rows_.tolist():
                    i = at[s1 - adj, s2 - adj]
                    if refs_[i] != last:
                        head, last, n = (s1 - axes[i], s2), refs_[i], 0
                    cells.append((last, queries[i], strands[i], s1 - axes[i], s2, size, adj, n, *head))
                    n += 1
        return pd.DataFrame(cells, columns=["ref_id", "qry_id", "strand", "s1", "s2", "len", "adj", "ord", "h1", "h2"])

    chained = _in_groups(grouped, [*on, "root_s2", "root_s1"], ["s2", "s1"], run, "ref_id string, qry_id string, strand int, s1 long, s2 long, len long, adj long, ord int, h1 long, h2 long")
    number = F.dense_rank().over(Window.partitionBy(*PAIR).orderBy("h1", "h2")) - 1
    return chained.withColumn("cluster_id", number.cast("long")).select(*(c.split()[0] for c in cluster.SCHEMA.split(", ")))
