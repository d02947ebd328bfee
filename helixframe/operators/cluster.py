"""Clusters of matches: filter, connect, and peel off best chains."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.chains import Bests, best_links
from helixframe.operators.groups import in_groups, tasks_of

SCHEMA = "ref_id string, qry_id string, strand int, cluster_id long, ord int, s1 long, s2 long, len long, adj long"


def thin(matches: np.ndarray) -> np.ndarray:
    """Without matches that are internal to a repeat; rows ``s1, s2, len``, in order of ``s2, s1``.

    Overlapping or touching matches of one diagonal are one. Two matches are rivals if they start at
    one place on a side and share on the other side at least half of the shorter. A match goes if it
    has a longer rival, or rivals of its own length both before and after it, so that of a tandem
    repeat's copies the first and the last stay.
    """
    m = _one_on_a_diagonal(np.asarray(matches, np.int64).reshape(-1, 3))
    place = np.arange(len(m))
    beaten, before, after = (np.zeros(len(m), bool) for _ in range(3))
    for same, across in ((0, 1), (1, 0)):
        order = np.lexsort((place, m[:, across], m[:, same]))
        for group in np.split(order, np.flatnonzero(np.diff(m[order, same])) + 1):
            if len(group) > 1:
                _rivals(m[group, across], m[group, 2], place[group], group, beaten, before, after)
    return m[~(beaten | before & after)]


def _rivals(start: np.ndarray, size: np.ndarray, place: np.ndarray, group: np.ndarray, beaten: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """Mark matches of one ``group``, which begin at one place and on the other side at ascending ``start``.

    Matches enter from the longest to the shortest. One of size ``n`` is rivalled by a longer one that
    shares ``n // 2`` letters, so that begins at most ``n - n // 2`` later and ends at least ``n // 2`` after
    the start: of those in reach of the one bound the furthest end decides. Twins of one size that share as
    much begin at most ``n - n // 2`` apart, so their places' least and greatest are those of a window.
    """
    rank = {x: i for i, x in enumerate(np.unique(start).tolist())}
    starts, reach = list(rank), Bests(len(rank))
    by_size = np.argsort(-size, kind="stable")
    for some in np.split(by_size, np.flatnonzero(np.diff(size[by_size])) + 1):
        n = int(size[some[0]])
        some = some[np.argsort(start[some], kind="stable")]
        for i in some.tolist():
            furthest = reach.below(bisect_right(starts, int(start[i]) + n - n // 2))
            if furthest is not None and furthest[0] >= start[i] + n // 2:
                beaten[group[i]] = True
        at, slots = start[some], place[some]
        lo, hi = np.searchsorted(at, at - (n - n // 2), "left"), np.searchsorted(at, at + (n - n // 2), "right")
        before[group[some]] |= _window(np.minimum, slots, lo, hi) < slots
        after[group[some]] |= _window(np.maximum, slots, lo, hi) > slots
        for i in some.tolist():
            reach.add(rank[int(start[i])], (int(start[i]) + n,))


def _window(least: np.ufunc, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least (or greatest) of ``values`` from each ``lo`` up to ``hi``, by stretches of powers of two."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        levels.append(least(levels[-1][: len(levels[-1]) - width], levels[-1][width:]))
        width *= 2
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k in np.unique(level).tolist():
        some = level == k
        out[some] = least(levels[k][lo[some]], levels[k][hi[some] - (1 << k)])
    return out


def _one_on_a_diagonal(m: np.ndarray) -> np.ndarray:
    if not len(m):
        return m
    m = m[np.lexsort((m[:, 1], m[:, 1] - m[:, 0]))]
    diagonal, end = m[:, 1] - m[:, 0], m[:, 1] + m[:, 2]
    base = np.cumsum(np.concatenate([[0], (np.diff(diagonal) != 0).astype(np.int64)])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)  # within a diagonal: none reaches beyond its base
    first = np.flatnonzero(np.concatenate([[True], m[1:, 1] + base[1:] > reach[:-1]]))
    last = np.append(first[1:], len(m)) - 1
    out = np.column_stack([m[first, 0], m[first, 1], reach[last] - base[last] - m[first, 1]])
    return out[np.lexsort((out[:, 0], out[:, 1]))]


def connected(m: np.ndarray, max_gap: int, diagonal: int, factor: float) -> np.ndarray:
    """Component of each match (sorted by ``s2, s1``): linked if no further than ``max_gap`` apart and on near diagonals."""
    n = len(m)
    root = np.arange(n)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    diag, end, starts = m[:, 1] - m[:, 0], m[:, 1] + m[:, 2], m[:, 1]
    for i in range(n):
        stop = int(np.searchsorted(starts, end[i] + max_gap, "right"))
        j = np.arange(i + 1, stop)
        apart = starts[j] - end[i]
        near = np.abs(diag[j] - diag[i]) <= np.maximum(diagonal, np.trunc(factor * apart))
        for k in j[near]:
            a, b = top(i), top(int(k))
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)])


def peel(m: np.ndarray, least: int, by_extent: bool = False) -> list[np.ndarray]:
    """Best chains of one component until nothing is left: rows ``s1, s2, len, adj``; short ones are dropped, not kept back."""
    out, rest = [], m
    while len(rest):
        n = len(rest)
        s1, s2, size = rest.T
        score, came, trim = size.astype(np.int64).copy(), np.full(n, -1), np.zeros(n, np.int64)
        for i in range(1, n):
            over = np.maximum(np.maximum(s1[:i] + size[:i] - s1[i], s2[:i] + size[:i] - s2[i]), 0)
            value = score[:i] + size[i] - over - np.abs((s2[:i] - s1[:i]) - (s2[i] - s1[i]))
            k = int(np.argmax(value))
            if value[k] > score[i]:
                score[i], came[i], trim[i] = value[k], k, over[k]
        at, chain = int(np.argmax(score)), []
        while at >= 0:
            chain.append(at)
            at = came[at]
        chain.reverse()
        rows = np.column_stack([rest[chain], np.where(np.arange(len(chain)) > 0, trim[chain], 0)])
        extent = rows[-1, 0] + rows[-1, 2] - rows[0, 0]
        if (extent if by_extent else rows[:, 2].sum()) >= least:
            rows[:, 0] += rows[:, 3]
            rows[:, 1] += rows[:, 3]
            rows[:, 2] -= rows[:, 3]
            out.append(rows[rows[:, 2] > 0])
        rest = np.delete(rest, chain, axis=0)
    return out


def _of_pair(m: np.ndarray, max_gap: int, min_cluster: int, diagonal: int, factor: float, by_extent: bool) -> list[np.ndarray]:
    """The chains of one reference, query and strand, in order of their first matches; ``m`` are ``s1, s2, len``."""
    if len(m) == 1:
        return [np.append(m, [[0]], axis=1)] if m[0, 2] >= max(min_cluster, 1) else []
    m = thin(m)
    groups = connected(m, max_gap, diagonal, factor)
    found = [rows for g in np.unique(groups) for rows in peel(m[groups == g], min_cluster, by_extent)]
    return sorted(found, key=lambda r: (r[0, 0], r[0, 1]))


def clusters(matches: DataFrame, max_gap: int = 90, min_cluster: int = 65, diagonal: int = 5, factor: float = 0.12, by_extent: bool = False) -> DataFrame:
    """``ref_id, qry_id, strand, cluster_id, ord, s1, s2, len, adj``: chained matches, overlaps trimmed off their starts.

    Matches of one reference, query and strand are clustered together; different references never
    share a cluster. Pairs come as a stream in a fixed number of tasks, and those that have too few letters go at once.
    """

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)

    def run(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        m = np.column_stack([table[c].to_numpy() for c in ("s1", "s2", "len")])
        at, cells = [], []
        # no chain is longer than the letters of its pair
        hopeful = np.arange(len(bounds) - 1) if by_extent else np.flatnonzero(np.add.reduceat(m[:, 2], bounds[:-1]) >= min_cluster)
        for a, z in zip(bounds[hopeful].tolist(), bounds[hopeful + 1].tolist(), strict=True):
            made = [(k, i, *r) for k, rows in enumerate(_of_pair(m[a:z], max_gap, min_cluster, diagonal, factor, by_extent)) for i, r in enumerate(rows.tolist())]
            cells += made
            at += [a] * len(made)
        own = table.select(["ref_id", "qry_id", "strand"]).take(pa.array(at, pa.int64())).combine_chunks()
        made = [pa.array([c[i] for c in cells], kind) for i, kind in enumerate(kinds)]
        columns = [*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in own.columns), *made]
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = matches.select("ref_id", "qry_id", F.col("strand").cast("int").alias("strand"), *(F.col(c).cast("long").alias(c) for c in ("s1", "s2", "len")))
    return in_groups(rows, ["ref_id", "qry_id", "strand"], ["s2", "s1"], run, SCHEMA, tasks_of(rows))


def consistent_set(matches: DataFrame) -> DataFrame:
    """Add ``kept``: in the longest chain of a pair that advances on both sides, overlaps taken off."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["s1", "s2"], kind="stable").reset_index(drop=True)
        s1, s2, size = (part[c].to_numpy(np.int64) for c in ("s1", "s2", "len"))
        score, _, came = best_links(
            s1, s1 + size - 1, s2, s2 + size - 1, np.ones(len(part), np.int64), size, lambda i, overlap: size[i] - overlap,
            lambda i, j, overlap: (s1[j] < s1[i]) & (s2[j] < s2[i]) & (overlap < size[i]), near=False,
        )
        kept, at = np.zeros(len(part), bool), int(np.argmax(score))
        while at >= 0:
            kept[at], at = True, came[at]
        return part.assign(kept=kept)

    cols = ["ref_id", "qry_id", "strand", "s1", "s2", "len"]
    return matches.select(*cols).groupBy("ref_id", "qry_id", "strand").applyInPandas(run, "ref_id string, qry_id string, strand int, s1 long, s2 long, len long, kept boolean")


def listing(clustered: DataFrame) -> DataFrame:
    """Cluster rows with the gaps to the match before, ready to be written."""
    from helixframe.operators.structure import gaps_between

    named = clustered.withColumn("cluster_id", F.struct("ref_id", "qry_id", "strand", "cluster_id"))
    return gaps_between(named).withColumn("cluster_id", F.col("cluster_id.cluster_id"))
