"""Chains that advance on both sides, for many rows in one group.

A row can follow one that starts no later on either side; what they share is taken off. Rows that end
before it on both sides share nothing, so of these only the best matters: rows are taken in the order of
their start, enter a tree of running bests (over their ends on the second side) once they end before the current
row on the first, and one query finds it. Rows that reach into the current one, on either side, lie in a stretch of
the rows in order of their starts on that side; of these only those are compared whose score is not below the
best one's, since an overlap adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


#: Rows that are held as plain numbers at once.
AT_ONCE = 1 << 16


class Bests:
    """The largest of the keys whose rank is below a bound."""

    def __init__(self, size: int):
        self.held: list[tuple | None] = [None] * (size + 1)

    def add(self, rank: int, key: tuple) -> None:
        at = rank + 1
        while at < len(self.held):
            if self.held[at] is not None and self.held[at] >= key:
                break  # and so is what holds more
            self.held[at] = key
            at += at & -at

    def below(self, rank: int) -> tuple | None:
        best = None
        while rank:
            held = self.held[rank]
            if held is not None and (best is None or best < held):
                best = held
            rank -= rank & -rank
        return best


class Reaching:
    """Rows in order of their starts on one side, of which a stretch holds all that reach a place."""

    def __init__(self, start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray, rows: np.ndarray):
        self.end, self.other_start, self.other_end, self.rows = end, other_start, other_end, rows
        self.score = np.full(len(rows), -np.inf)
        self.furthest = np.maximum.accumulate(end) if len(end) else end
        self.start = start

    def stretches(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place where the rows that reach it begin, and where those that start at it or before end."""
        return np.searchsorted(self.furthest, place), np.searchsorted(self.start, place, "right")


def best_links(lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, way: np.ndarray, own: np.ndarray, after: Callable[[int, np.ndarray], np.ndarray], allowed: Callable[[int, np.ndarray, np.ndarray], np.ndarray], near: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``score, gap, came`` of rows in order of ``lo1``: the best chain that ends in each, and the row before it (-1: none).

    ``own``: scores of single rows. ``after(i, overlaps)``: what row ``i`` adds after rows that it shares so much with, no more
    for a larger overlap; ``allowed(i, rows, overlaps)``: which of them it can follow. A chain must beat the row alone. Of equal scores the
    one with the least distances on both sides, summed, wins if ``near``, then the first row.
    """
    n = len(lo1)
    score, gap, came = own.astype(np.float64), np.zeros(n), np.full(n, -1)
    trees = {}
    places = np.zeros((6, n), np.int64)  # of each row: its places on both sides, and the stretches that reach it
    for w in set(way.tolist()):
        rows = np.flatnonzero(way == w)
        second = rows[np.argsort(lo2[rows], kind="stable")]
        sides = Reaching(lo1[rows], hi1[rows], lo2[rows], hi2[rows], rows), Reaching(lo2[second], hi2[second], lo1[second], hi1[second], second)
        places[0, rows], places[1, second] = np.arange(len(rows)), np.arange(len(rows))
        places[2, rows], _ = sides[0].stretches(lo1[rows])
        places[3, rows] = np.arange(len(rows))
        places[4, rows], places[5, rows] = sides[1].stretches(lo2[rows])
        ends = np.unique(hi2[rows])
        trees[w] = (np.searchsorted(ends, hi2[rows]), np.searchsorted(ends, lo2[rows]), Bests(len(ends)), *sides)
    at_end, at_start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for w, (of_end, of_start, *_) in trees.items():
        at_end[way == w], at_start[way == w] = of_end, of_start
    by_end, done, none = np.argsort(hi1, kind="stable"), 0, np.zeros(1, np.int64)
    for base in range(0, n, AT_ONCE):
        some = slice(base, base + AT_ONCE)
        for i, (a1, a2, w, k1, k2, b1, e1, b2, e2, start) in enumerate(zip(lo1[some].tolist(), lo2[some].tolist(), way[some].tolist(), *places[:, some].tolist(), at_start[some].tolist(), strict=True), base):
            while done < n and hi1[by_end[done]] < a1:
                j = int(by_end[done])
                trees[int(way[j])][2].add(int(at_end[j]), (float(score[j]), -(float(gap[j]) - int(hi1[j]) - int(hi2[j])) if near else 0, -j))
                done += 1
            _, _, bests, first, second = trees[w]
            found, least = [], -np.inf
            if (best := bests.below(start)) is not None:
                j, least = -best[2], best[0]
                found.append((best[0] + after(i, none)[0], gap[j] + abs(a1 - int(hi1[j])) + abs(a2 - int(hi2[j])) if near else 0, j))
            met = []
            k = (first.score[b1:e1] >= least).nonzero()[0]
            if len(k):
                k += b1
                k = k[(first.end[k] >= a1) & (first.other_start[k] <= a2)]
                met.append(first.rows[k])
            k = (second.score[b2:e2] >= least).nonzero()[0]
            if len(k):
                k += b2
                k = k[(second.end[k] >= a2) & (second.other_end[k] < a1)]
                met.append(second.rows[k])
            if met and len(met := met[0] if len(met) == 1 else np.concatenate(met)):
                overlap = np.maximum(np.maximum(hi1[met] - (a1 - 1), hi2[met] - (a2 - 1)), 0)
                s = np.where(allowed(i, met, overlap), score[met] + after(i, overlap), -np.inf)
                most = np.maximum.reduce(s)
                if most > score[i] and (not found or most >= found[0][0]):
                    met = met[s == most]
                    d = gap[met] + np.abs(a1 - hi1[met]) + np.abs(a2 - hi2[met]) if near else np.zeros(len(met))
                    found += [(most, float(x), j) for x, j in zip(d.tolist(), met.tolist(), strict=True)]
            if found:
                s, d, j = min(found, key=lambda f: (-f[0], f[1], f[2]))
                if s > score[i]:
                    score[i], gap[i], came[i] = s, d, j
            first.score[k1] = second.score[k2] = score[i]
    return score, gap, came
