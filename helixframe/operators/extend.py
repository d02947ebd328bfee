"""Gapped alignments from clusters of exact matches.

One row per pair of sequences holds its clusters and both sequences; a pair is extended by itself.
Between the matches of a cluster, and on to the cluster that is the best target, the letters are
aligned end to end; an alignment grows until its score has not risen for ``break_length``
anti-diagonals, and is cut back to its best end. An alignment that starts anew also grows backwards,
towards the earlier alignment that is its best target, and where it reaches that one's end the two
become one, with the letters between them aligned once more, forwards and to their ends. A cluster
inside an alignment of its own direction is not started again, and none is continued twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement, revcomp
from helixframe.operators.groups import tasks_of
from helixframe.operators.seeds import code_points
from helixframe.operators.variants import GAP, contract, errors
from helixframe.sources.alignments import SCHEMA


#: The published substitution scores of 20 amino acids, lower triangle, rows and columns in this order.
BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
#: Scores of a stop against a stop and against a letter, and of any other letter.
STOP_STOP, STOP_LETTER, OTHER = 1, -4, -1


@cache
def scores_of(matrix: str) -> np.ndarray:
    """Scores by character codes (128, 128), either case, of a lower triangle as text; other triangles are given the same way."""
    table = np.full((128, 128), OTHER, np.int64)
    letters: list[str] = []
    for line in matrix.split("\n"):
        if cells := line.split():
            letters.append(cells[0])
            for other, score in zip(letters, cells[1:], strict=True):
                for x in {cells[0], cells[0].lower()}:
                    for y in {other, other.lower()}:
                        table[ord(x), ord(y)] = table[ord(y), ord(x)] = int(score)
    table[ord("*"), :] = table[:, ord("*")] = STOP_LETTER
    table[ord("*"), ord("*")] = STOP_STOP
    return table


@dataclass(frozen=True)
class Options:
    """Defaults of nucleotide alignment; ``text`` scores any equal letters, not only acgt."""

    min_match: int = 20
    min_cluster: int = 65
    max_gap: int = 90
    diagonal: int = 5
    factor: float = 0.12
    break_length: int = 200
    strand: str = "both"
    matches: str = "reference"  # all, reference (unique there), unique (in both)
    extend: bool = True
    simplify: bool = True
    min_length: int = 0
    text: bool = False
    window: int = 10_000
    good: int = 3
    bad: int = -7
    gap_open: int = -10
    gap_more: int = -7
    tiled: bool = False  # a pair's clusters by many tasks (``operators.band``)
    one_axis: bool = False  # clusters over all references end to end, by many tasks too
    to_end: bool = False  # an alignment without a target goes on to the end of the shorter sequence, if the search gets there
    matrix: str = ""  # scores of letters, as text (see ``scores_of``); none: ``good`` and ``bad``


#: Defaults of the stand-alone cluster step.
CLUSTER_ONLY = Options(diagonal=5, max_gap=1000, min_cluster=200, factor=0.05)
#: Defaults of six-frame protein alignment.
PROTEIN = Options(min_match=6, min_cluster=20, max_gap=30, factor=0.11, break_length=60, text=True, good=8, gap_more=-1, matrix=BLOSUM62)

LOW = -(1 << 40)


#: How ``affine`` ends: at its best place; at the far corner if the search gets there, else at its best place; at the far
#: corner in any case; at the far corner, else where the shorter stretch ends, else at its best place.
BEST, TARGET, FORCED, TO_END = "best", "target", "forced", "to end"
#: Places whose origins are kept; beyond them the origins of a block of anti-diagonals are found again when they are needed.
TRACED = 1 << 22


def _taken(arrays: list[np.ndarray] | None, begin: int, at: np.ndarray) -> list[np.ndarray]:
    if arrays is None:
        return [np.full(len(at), LOW)] * 3
    k = at - begin
    ok = (k >= 0) & (k < len(arrays[0]))
    k = np.where(ok, k, 0)
    return [np.where(ok, a[k], LOW) for a in arrays]


def _diagonal(ref: np.ndarray, qry: np.ndarray, acgt: np.ndarray, o: Options, d: int, lo: int, hi: int, last: tuple, before: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    """Places ``lo..hi`` of anti-diagonal ``d`` after the two before it: best scores that end in a pair, a reference base alone, a query base alone; and their origins."""
    i = np.arange(lo, hi + 1)
    j = d - i
    left, up, corner = _taken(*last, i - 1), _taken(*last, i), _taken(*before, i - 1)
    pair = (i > 0) & (j > 0)
    a, b = ref[np.maximum(i - 1, 0)], qry[np.maximum(j - 1, 0)]
    worth = scores_of(o.matrix)[np.minimum(a, 127), np.minimum(b, 127)] if o.matrix else np.where((a == b) & acgt[np.maximum(i - 1, 0)], o.good, o.bad)
    from_m = np.stack(corner)
    m_from = from_m.argmax(axis=0)  # M before D before I on ties
    score_m = np.where(pair, from_m.max(axis=0) + worth, LOW)
    opened = np.stack([left[0] + o.gap_open, left[1] + o.gap_more, left[2] + o.gap_open])
    d_from, score_d = opened.argmax(axis=0), np.where(i > 0, opened.max(axis=0), LOW)
    opened = np.stack([up[0] + o.gap_open, up[1] + o.gap_open, up[2] + o.gap_more])
    i_from, score_i = opened.argmax(axis=0), np.where(j > 0, opened.max(axis=0), LOW)
    return [score_m, score_d, score_i], (m_from | d_from << 2 | i_from << 4).astype(np.uint8)


def affine(ref: np.ndarray, qry: np.ndarray, o: Options, mode: str, traced: int = TRACED) -> tuple[int, int, str, bool]:
    """Align two stretches from their first letters; their gapped forms as letters ``M, D, I``.

    The search goes by anti-diagonals and leaves out cells that are too far below the best score so far; it
    is over when that has not risen for ``break_length`` anti-diagonals. ``FORCED`` compares a cell with its own
    anti-diagonal alone and never gives up. Returns the letters used of each, the operations, and whether the far
    corner was reached.

    Origins of ``traced`` places are kept. Of what comes after, the scores of one anti-diagonal in each block
    are, and the way back finds a block's origins again from them: memory goes with the square root of the number
    of anti-diagonals times their width, time at most doubles, and the operations are the same.
    """
    n, m = len(ref), len(qry)
    if not n or not m:
        far = mode == FORCED or not n + m or mode == TARGET and n + m <= o.break_length
        return (n, m, "D" * n + "I" * m, True) if far and mode != BEST else (0, 0, "", not n + m)
    drop = o.good * o.break_length
    last, before = ([np.array([0]), np.array([LOW]), np.array([LOW])], 0), (None, 0)
    bounds: list[tuple[int, int]] = [(0, 0)]
    cells: dict[int, np.ndarray] = {0: np.zeros(1, np.uint8)}
    block, held, kept = max(16, int((48 * (n + m)) ** 0.5)), 0, {}
    high, high_at, high_d = 0, (0, 0), 0
    edge, edge_at = LOW, None  # best place where the shorter stretch ends
    acgt = np.isin(ref, np.frombuffer(b"acgtACGT", np.uint8)) if not o.text else np.ones(n, bool)
    for d in range(1, n + m + 1):
        if mode != FORCED and d - high_d > o.break_length:
            break
        lo, hi = max(last[1], d - m), min(last[1] + len(last[0][0]), d, n)
        if lo > hi:
            break
        scores, origins = _diagonal(ref, qry, acgt, o, d, lo, hi, last, before)
        best = np.maximum(np.maximum(scores[0], scores[1]), scores[2])
        keep = np.flatnonzero((best.max() if mode == FORCED else high) - best <= drop)
        if not len(keep):
            break
        s = slice(keep[0], keep[-1] + 1)
        if held > traced and not (d - 1) % block:
            kept[d] = last, before  # what the block's first anti-diagonal follows
        before, last = last, ([x[s] for x in scores], lo + int(keep[0]))
        bounds.append((last[1], last[1] + len(last[0][0]) - 1))
        if held <= traced or not kept:
            cells[d] = origins[s]
            held += len(cells[d])
        top = int(best[s].max())
        if top >= high:
            k = int(np.flatnonzero(best[s] == top)[-1])
            high, high_at, high_d = top, (last[1] + k, d - last[1] - k), d
        if mode == TO_END:
            i = n if n <= m else d - m
            if d >= min(n, m) and bounds[-1][0] <= i <= bounds[-1][1] and best[i - lo] >= edge:
                edge, edge_at = int(best[i - lo]), ((i, d - i), int(np.argmax([x[i - lo] for x in scores])))
    far = len(bounds) == n + m + 1 and bounds[-1][0] <= n <= bounds[-1][1]
    if far and mode != BEST:
        at, state = (n, m), int(np.argmax([x[n - last[1]] for x in last[0]]))
    elif edge_at is not None:
        at, state = edge_at
    elif high_at == (0, 0):
        return 0, 0, "", False
    else:
        at, state = high_at, 0

    def again(first: int, upto: int) -> dict[int, np.ndarray]:
        """Origins of the anti-diagonals ``first..upto`` once more."""
        found, (last, before) = {}, kept[first]
        for d in range(first, upto + 1):
            lo, hi = max(last[1], d - m), min(last[1] + len(last[0][0]), d, n)
            scores, origins = _diagonal(ref, qry, acgt, o, d, lo, hi, last, before)
            s = slice(bounds[d][0] - lo, bounds[d][1] + 1 - lo)
            found[d] = origins[s]
            before, last = last, ([x[s] for x in scores], bounds[d][0])
        return found

    found: dict[int, np.ndarray] = {}

    def block_of(d: int) -> np.ndarray:
        if d not in found:
            found.clear()
            found.update(again(max(x for x in kept if x <= d), d))
        return found[d]

    i, j = at
    ops: list[str] = []
    while i or j:
        d = i + j
        came = int((cells[d] if d in cells else block_of(d))[i - bounds[d][0]])
        if state == 0:
            ops.append("M")
            state, i, j = came & 3, i - 1, j - 1
        elif state == 1:
            ops.append("D")
            state, i = came >> 2 & 3, i - 1
        else:
            ops.append("I")
            state, j = came >> 4 & 3, j - 1
    return at[0], at[1], "".join(reversed(ops)), far and at == (n, m)


def _reachable(gap1: int, gap2: int, o: Options) -> bool:
    more, less = max(gap1, gap2), min(gap1, gap2)
    return more < o.break_length or less * o.good + (more - less) * o.gap_more >= 0


def _best_target(gaps: Iterator[tuple[int, int, object]], dist: int, o: Options):
    """Of what lies ``gap1, gap2`` letters away the first within reach, else the one that is least out of the way, if less than ``dist``."""
    found = None
    for gap1, gap2, what in gaps:
        if _reachable(gap1, gap2, o):
            return what
        away = 2 * max(gap1, gap2) - min(gap1, gap2)
        if away < dist:
            found, dist = what, away
    return found


class _Extender:
    """The alignments of one pair and direction: lists of ``lo1, hi1, lo2, hi2`` (half open) and operations."""

    def __init__(self, ref: np.ndarray, qry: np.ndarray, todo: list[list[tuple[int, int, int]]], o: Options):
        self.r, self.q, self.todo, self.o = ref, qry, todo, o
        self.used = [False] * len(todo)
        self.out: list[list] = []

    def inside(self, k: int) -> bool:
        """Whether a finished alignment covers the cluster on both sides."""
        (a, b, _), (x, y, size) = self.todo[k][0], self.todo[k][-1]
        return self.o.simplify and any(lo1 <= a and x + size <= hi1 and lo2 <= b and y + size <= hi2 for lo1, hi1, lo2, hi2, _ in self.out)

    def _before(self, now: list) -> Iterator[tuple[int, int, list]]:
        for other in reversed(self.out):
            gap1, gap2 = now[0] + 1 - other[1], now[2] + 1 - other[3]
            if gap1 >= 0 and gap2 >= 0:
                yield gap1, gap2, other

    def _after(self, k: int, now: list) -> Iterator[tuple[int, int, tuple[int, int]]]:
        for x in range(k + 1, len(self.todo)):
            if not self.used[x]:
                # the first match of the cluster that starts beyond
                for i, (s1, s2, _) in enumerate(self.todo[x]):
                    gap1, gap2 = s1 + 1 - now[1], s2 + 1 - now[3]
                    if gap1 >= 0 and gap2 >= 0:
                        yield gap1, gap2, (x, i)
                        break

    def backwards(self, now: list) -> list:
        """Grow ``now``, an exact match, towards an earlier alignment; the alignment that it is part of afterwards."""
        o = self.o
        target = _best_target(self._before(now), min(now[0], now[2]) + 1, o)
        if target is not None:
            shared = max(0, target[1] - now[0], target[3] - now[2])  # the last letter of one may be the first of the other
            now[0], now[2], now[4] = now[0] + shared, now[2] + shared, now[4][shared:]
        far1, far2 = (target[1], target[3]) if target is not None else (0, 0)
        a, b = max(far1, now[0] - o.window), max(far2, now[2] - o.window)
        within = target is not None and (a, b) == (far1, far2)
        u, v, _, reached = affine(self.r[a : now[0]][::-1], self.q[b : now[2]][::-1], o, TARGET if within else TO_END if target is None and o.to_end else BEST)
        joined = affine(self.r[now[0] - u : now[0]], self.q[now[2] - v : now[2]], o, FORCED)[2]
        if within and reached:
            target[1], target[3], target[4] = now[1], now[3], target[4] + joined + now[4]
            return target
        now[0], now[2], now[4] = now[0] - u, now[2] - v, joined + now[4]
        self.out.append(now)
        return now

    def forwards(self, now: list, to: tuple[int, int] | None) -> bool:
        """Grow ``now`` to where a match begins, or as far as it pays; whether it got there."""
        far1, far2 = to or (len(self.r), len(self.q))
        a, b = min(far1, now[1] + self.o.window), min(far2, now[3] + self.o.window)
        within = to is not None and (a, b) == to
        u, v, ops, reached = affine(self.r[now[1] : a], self.q[now[3] : b], self.o, TARGET if within else TO_END if to is None and self.o.to_end else BEST)
        now[1], now[3], now[4] = now[1] + u, now[3] + v, now[4] + ops
        return within and reached

    def run(self) -> None:
        o, k, first, entry, now = self.o, 0, 0, 0, None
        while k < len(self.todo):
            if now is None and (self.used[k] or o.extend and self.inside(k)):
                first += 1
                k = first
                continue
            self.used[k], target = True, None
            cluster = self.todo[k]
            for i in range(entry, len(cluster)):
                s1, s2, size = cluster[i]
                skip = max(0, now[1] - s1, now[3] - s2) if now is not None else 0
                if skip >= size:
                    continue
                if now is not None:
                    now[1], now[3], now[4] = s1 + size, s2 + size, now[4] + "M" * (size - skip)
                else:
                    now = [s1, s1 + size, s2, s2 + size, "M" * size]
                    if o.extend or i:
                        now = self.backwards(now)
                    else:
                        self.out.append(now)
                if i + 1 < len(cluster):
                    beyond = max(0, now[1] - cluster[i + 1][0], now[3] - cluster[i + 1][1])
                    to = (cluster[i + 1][0] + beyond, cluster[i + 1][1] + beyond)
                elif o.extend:
                    target = _best_target(self._after(k, now), min(len(self.r) - now[1], len(self.q) - now[3]) + 1, o)
                    to = None
                    if target is not None:
                        s1, s2, _ = self.todo[target[0]][target[1]]
                        beyond = max(0, now[1] - s1, now[3] - s2)
                        to = (s1 + beyond, s2 + beyond)
                else:
                    break
                if not self.forwards(now, to):
                    now = None
            if target is None or now is None:
                now, entry = None, 0
                first += 1
                k = first
            else:
                k, entry = target


def extend_pair(ref: str, qry: str, found: list[list[tuple[int, int, int]]], o: Options) -> list[tuple[int, int, int, int, str]]:
    """Alignments of one direction: ``lo1, hi1, lo2, hi2`` from 1, and operations; ``found`` are clusters of matches."""
    r, q = code_points(ref), code_points(qry)
    if not o.text:
        r, q = r.astype(np.uint8), q.astype(np.uint8)
    todo = sorted([(a - 1, b - 1, size) for a, b, size in c] for c in found if c)
    made = _Extender(r, q, todo, o)
    made.run()
    out = [(a + 1, b, c + 1, d, ops) for a, b, c, d, ops in made.out]
    if o.simplify:
        out = [x for x in out if not any(y is not x and y[0] <= x[0] and x[1] <= y[1] and y[2] <= x[2] and x[3] <= y[3] and (y[:4] != x[:4]) for y in out)]
    return out


def protein_errors(one: str, two: str, matrix: str) -> tuple[int, int, int]:
    """Differing columns, columns whose score isn't positive (gaps too), and stops or other non-letters of both sides, of an expansion; a dash is a gap too."""
    table, gaps = scores_of(matrix), (GAP, "-")
    gap = [a in gaps or b in gaps for a, b in zip(one, two, strict=True)]
    off = sum(g or a.upper() != b.upper() for a, b, g in zip(one, two, gap, strict=True))
    similar = sum(g or table[min(ord(a), 127), min(ord(b), 127)] < 1 for a, b, g in zip(one, two, gap, strict=True))
    return off, int(similar), sum(x not in gaps and not x.isalpha() for x in one + two)


def gapped(ref: str, qry: str, ops: str) -> tuple[str, str]:
    """The stretches with gaps where the operations say."""
    one, two, i, j = [], [], 0, 0
    for op in ops:
        one.append(GAP if op == "I" else ref[i])
        two.append(GAP if op == "D" else qry[j])
        i, j = i + (op != "I"), j + (op != "D")
    return "".join(one), "".join(two)


def extend(clusters: DataFrame, refs: DataFrame, queries: DataFrame, o: Options = Options()) -> DataFrame:
    """Alignments of all pairs that have clusters."""
    grouped = clusters.groupBy("ref_id", "qry_id").agg(F.sort_array(F.collect_list(F.struct("strand", "cluster_id", "ord", "s1", "s2", "len"))).alias("m"))
    pairs = grouped.join(refs.select(F.col("seq_id").alias("ref_id"), F.col("seq").alias("ref_seq")), "ref_id").join(queries.select(F.col("seq_id").alias("qry_id"), F.col("seq").alias("qry_seq")), "qry_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 9, pa.list_(pa.int64()), pa.string()]
        for b in batches:
            out = []
            for ref_id, qry_id, m, ref, qry in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                for strand in (1, -1):
                    found: dict[int, list] = {}
                    for x in m:
                        if x["strand"] == strand:
                            found.setdefault(x["cluster_id"], []).append((x["s1"], x["s2"], x["len"]))
                    if not found:
                        continue
                    mine = qry if strand > 0 else _turned(qry)
                    for lo1, hi1, lo2, hi2, ops in extend_pair(ref, mine, list(found.values()), o):
                        if o.min_length and max(hi1 - lo1, hi2 - lo2) + 1 < o.min_length:
                            continue
                        one, two = gapped(ref[lo1 - 1 : hi1], mine[lo2 - 1 : hi2], ops)
                        off, similar, odd = protein_errors(one, two, o.matrix) if o.matrix else errors(one, two)
                        if o.text and not o.matrix:
                            similar, odd = off, 0
                        s2, e2 = (lo2, hi2) if strand > 0 else (len(qry) - lo2 + 1, len(qry) - hi2 + 1)
                        out.append((0, ref_id, qry_id, len(ref), len(qry), lo1, hi1, s2, e2, off, similar, odd, contract(one, two), "dna"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    made = pairs.select("ref_id", "qry_id", "m", F.coalesce("ref_seq", F.lit("")).alias("ref_seq"), F.coalesce("qry_seq", F.lit("")).alias("qry_seq")).repartition(tasks_of(pairs), "ref_id", "qry_id").mapInArrow(run, SCHEMA)
    # ids count rows; dealt by a fixed number and sorted, a row has the same one whenever it is computed
    dealt = made.repartition(tasks_of(made), "ref_id", "qry_id").sortWithinPartitions("ref_id", "qry_id", "s1", "e1", "s2", "e2", "deltas")
    return dealt.withColumn("aln_id", F.monotonically_increasing_id())


def _turned(seq: str) -> str:
    return "".join([c if c in "acgtn" else "n" for c in revcomp(seq)])


__all__ = ["CLUSTER_ONLY", "PROTEIN", "Options", "affine", "extend", "extend_pair", "gapped", "reverse_complement"]
