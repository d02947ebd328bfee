"""Rules of brief merge, knockout, thinning, protein scores, letter checks and saved seeds, by hand and by brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from helixframe.operators import coords, extend, gaps, matches, protein, seeds, variants
from helixframe.operators.cluster import thin
from helixframe.sources.alignments import _id


def boxes(spark, rows):
    """``aln_id, lo1, hi1, lo2, hi2, sim, dir2`` of one pair."""
    full = [(i, "r", "q", a, b, c, d, s, 1, w) for i, a, b, c, d, s, w in rows]
    return spark.createDataFrame(full, "aln_id long, ref_id string, qry_id string, lo1 long, hi1 long, lo2 long, hi2 long, sim double, dir1 int, dir2 int")


def test_brief_merge_needs_both_sides_and_no_direction(spark):
    rows = boxes(spark, [(1, 1, 100, 1, 100, 90.0, 1), (2, 50, 150, 90, 190, 90.0, -1), (3, 60, 160, 5000, 5100, 90.0, 1), (4, 140, 200, 185, 240, 90.0, 1), (5, 201, 210, 185, 240, 90.0, 1)])
    found = sorted((r.lo1, r.hi1, r.lo2, r.hi2, r.merged) for r in coords.merged(rows).collect())
    # 3 is far away on the query, 5 begins behind what was joined on the reference
    assert found == [(1, 200, 1, 240, 3), (60, 160, 5000, 5100, 1), (201, 210, 185, 240, 1)]


@pytest.mark.parametrize(
    ("rows", "left"),
    [
        ([(1, 1, 100, 1, 100, 95.0, 1), (2, 20, 110, 20, 110, 90.0, 1)], {1}),  # more similar and long enough
        ([(1, 1, 100, 1, 100, 90.0, 1), (2, 20, 110, 20, 110, 95.0, 1)], {2}),  # the later one is
        ([(1, 1, 100, 1, 100, 95.0, 1), (2, 20, 110, 20, 110, 90.0, -1)], {1, 2}),  # other strand
        ([(1, 1, 100, 1, 100, 95.0, 1), (2, 20, 110, 500, 590, 90.0, 1)], {1, 2}),  # apart on the query
        ([(1, 1, 100, 1, 100, 95.0, 1), (2, 60, 300, 60, 300, 90.0, 1)], {1, 2}),  # too little overlap
        ([(1, 1, 100, 1, 100, 95.0, 1), (2, 40, 300, 40, 300, 90.0, 1)], {2}),  # more similar but far shorter
        ([(1, 1, 100, 1, 100, 90.0, 1), (2, 2, 101, 2, 101, 95.0, 1), (3, 3, 102, 3, 102, 92.0, 1)], {2}),
    ],
)
def test_knockout(spark, rows, left):
    assert {r.aln_id for r in coords.knockout(boxes(spark, rows)).collect()} == left


def test_thin_against_the_rule():
    rng = random.Random(6)
    for _ in range(300):
        m = sorted({(rng.randint(1, 12), rng.randint(1, 12), rng.randint(1, 9)) for _ in range(rng.randint(0, 12))}, key=lambda x: (x[1], x[0]))
        joined = []
        for diagonal in sorted({b - a for a, b, _ in m}):
            for a, b, n in sorted((x for x in m if x[1] - x[0] == diagonal), key=lambda x: x[1]):
                if joined and joined[-1][1] - joined[-1][0] == diagonal and b <= joined[-1][1] + joined[-1][2]:
                    joined[-1][2] = max(joined[-1][2], b + n - joined[-1][1])
                else:
                    joined.append([a, b, n])
        joined.sort(key=lambda x: (x[1], x[0]))

        def rivals(x, y):
            for same, across in ((0, 1), (1, 0)):
                if x[same] == y[same] and min(x[across] + x[2], y[across] + y[2]) - max(x[across], y[across]) >= min(x[2], y[2]) // 2:
                    return True
            return False

        want = []
        for i, x in enumerate(joined):
            others = [(j, y) for j, y in enumerate(joined) if j != i and rivals(x, y)]
            twins = [j for j, y in others if y[2] == x[2]]
            if not any(y[2] > x[2] for _, y in others) and not (any(j < i for j in twins) and any(j > i for j in twins)):
                want.append(x)
        assert thin(np.array(m, np.int64).reshape(-1, 3)).tolist() == want


def test_letters_decide_where_hashes_collide(spark, monkeypatch):
    """With a hash of two values only, both match paths and saved seeds give what brute force gives."""
    monkeypatch.setattr(matches, "window_hashes", lambda x, n: seeds.window_hashes(x, n) & np.uint64(1))
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    core = text(14)
    refs = [("r1", text(9) + core + text(4)), ("r2", text(20))]
    queries = [("q1", text(5) + core + text(7)), ("q2", core[:9] + text(6))]

    def frame(rows):
        return spark.createDataFrame([(i, s, len(s)) for i, s in rows], "seq_id string, seq string, len long")

    want = set()
    for r, one in refs:
        for q, two in queries:
            for a in range(len(one)):
                for b in range(len(two)):
                    n = next((k for k in range(min(len(one) - a, len(two) - b)) if one[a + k] != two[b + k]), min(len(one) - a, len(two) - b))
                    if n >= 5 and not (a and b and one[a - 1] == two[b - 1]):
                        want.add((r, q, 1, a + 1, b + 1, n))
    streamed = matches.maximal_matches(frame(refs), frame(queries), 5)
    assert {tuple(r) for r in streamed.collect()} == want and want
    one, keyed = frame(refs), frame([(f"1\t{i}", s) for i, s in queries])
    hits = [(r, f"1\t{q}", a + 1, b + 1) for r, x in refs for q, y in queries for a in range(len(x) - 4) for b in range(len(y) - 4)]
    for size in (matches.PIECE, 6):
        joined = matches.verified(matches.islands(spark.createDataFrame(hits, "ref_id string, way_id string, s1 long, s2 long"), 5, 5), one, keyed, 5, size)
        assert sorted(tuple(r) for r in joined.collect()) == sorted(want)
    monkeypatch.setattr(seeds, "window_hashes", lambda x, n, whole=seeds.window_hashes: whole(x, n) & np.uint64(1))
    assert sorted(tuple(r) for r in matches.maximal_matches(frame(refs), frame(queries), 5, broadcast_letters=0).collect()) == sorted(want)


def test_every_occurrence_is_found(spark):
    rows = spark.createDataFrame([("a", "aaaa"), ("b", "xaxaxa"), ("c", ""), ("d", "a.a")], "seq_id string, seq string")
    places = lambda p: sorted((r.seq_id, r.pos) for r in matches.find(rows, p).collect())
    assert places("aa") == [("a", 1), ("a", 2), ("a", 3)] and places("axa") == [("b", 2), ("b", 4)] and places(".") == [("d", 2)]


def test_protein_scores():
    # A-A, L-I (2, similar), W-G (-2), gap, stop against stop, K-R (2, similar)
    assert extend.protein_errors("ALW-*K", "AIGC*R", extend.BLOSUM62) == (4, 2, 2)
    table = extend.scores_of(extend.BLOSUM62)
    assert (table == table.T).all() and table[ord("W"), ord("w")] == 11 and table[ord("*"), ord("A")] == -4


def test_protein_alignment_counts_substitutions(spark):
    """A reading frame with two conservative and one other substitution."""
    rng = random.Random(8)
    codon = {"A": "gct", "R": "cgt", "N": "aat", "D": "gat", "C": "tgt", "Q": "caa", "E": "gaa", "G": "ggt", "H": "cat", "I": "att", "L": "ctt", "K": "aaa", "M": "atg", "F": "ttt", "P": "cct", "S": "tct", "T": "act", "W": "tgg", "Y": "tat", "V": "gtt"}
    amino = [rng.choice("ARNDCQEGHIKMFPSTWYV") for _ in range(90)]
    amino[30], amino[45], amino[60] = "I", "K", "W"
    other = list(amino)
    other[30], other[45], other[60] = "V", "R", "G"
    one, two = ("".join(codon[a] for a in x) for x in (amino, other))
    frame = lambda i, s: spark.createDataFrame([(i, s, len(s))], "seq_id string, seq string, len long")
    rows = protein.align_protein(frame("r", one), frame("q", two)).collect()
    best = max(rows, key=lambda r: r.e1 - r.s1)
    assert (best.s1, best.e1, best.s2, best.e2) == (1, 270, 1, 270) and (best.errors, best.sim_errors, best.stops) == (3, 1, 0)
    assert best.sim == pytest.approx(100 * 89 / 90)


def test_buffer_reaches_beyond_the_ends(spark):
    rows = spark.createDataFrame([(1, "r", "q", 10, 10, 1, 10, 1, 10)], "aln_id long, ref_id string, qry_id string, ref_len long, qry_len long, s1 long, e1 long, s2 long, e2 long")
    off = spark.createDataFrame([(1, "r", "q", 2, 2, "A", "C", 1), (1, "r", "q", 9, 9, "A", "C", 8)], "aln_id long, ref_id string, qry_id string, p1 long, p2 long, sub_r string, sub_q string, col long")
    for side in ("reference", "query"):
        assert sorted((r.p1, r.buff) for r in variants.snps(off, rows, side).collect()) == [(2, 2), (9, 2)]


def test_regions_with_a_gap_too_long_have_no_rate(spark):
    cells = "ref_id string, qry_id string, strand int, cluster_id long, ord int, s1 long, s2 long, len long, gap1 long, gap2 long, gap_errors long"
    rows = [("r", "q", 1, 0, 0, 1, 1, 10, None, None, None), ("r", "q", 1, 0, 1, 20, 20, 10, 9, 9, 3), ("r", "q", 1, 1, 0, 1, 1, 10, None, None, None), ("r", "q", 1, 1, 1, 20000, 20000, 10, 19989, 19989, None)]
    found = {r.cluster_id: (r.errors, r.rate) for r in gaps.regions(spark.createDataFrame(rows, cells)).collect()}
    assert found == {0: (3, pytest.approx(3 / 29)), 1: (None, None)}


def test_ids_of_alignments_fit_or_fail():
    ids = {_id((p << 33) + at, k) for p in (0, 1, 5000) for at in (0, 7) for k in (0, 3)}
    assert len(ids) == 12 and max(ids) < 1 << 63
    with pytest.raises(OverflowError):
        _id(1 << 23, 0)


def all_pairs_chain(lo1, hi1, lo2, hi2, way, own, after, allowed, near):
    """Every row against every earlier one."""
    n = len(lo1)
    score, gap, came = [float(x) for x in own], [0.0] * n, [-1] * n
    for i in range(n):
        best = None
        for j in range(i):
            overlap = max(hi1[j] - lo1[i] + 1, hi2[j] - lo2[i] + 1, 0)
            one, shared = np.array([j]), np.array([overlap])
            if way[j] == way[i] and lo1[j] <= lo1[i] and lo2[j] <= lo2[i] and (overlap == 0 or allowed(i, one, shared)[0]):
                d = gap[j] + abs(lo1[i] - hi1[j]) + abs(lo2[i] - hi2[j]) if near else 0
                key = (-(score[j] + after(i, shared)[0]), d, j)
                best = key if best is None else min(best, key)
        if best is not None and -best[0] > score[i]:
            score[i], gap[i], came[i] = -best[0], best[1], best[2]
    return score, gap, came


def test_links_are_those_of_all_pairs():
    from helixframe.operators.chains import best_links

    rng = np.random.default_rng(4)
    for k in range(150):
        n, wide = int(rng.integers(1, 40)), int(rng.choice([30, 200]))
        lo1, lo2 = np.sort(rng.integers(0, wide, n)), rng.integers(0, wide, n)
        size = rng.integers(1, 25, n)
        hi1, hi2 = lo1 + size - 1, lo2 + size - 1 + (rng.integers(0, 3, n) if k % 2 else 0)
        way, weight = rng.choice([1, -1], n) if k % 3 else np.ones(n, np.int64), rng.choice([0.25, 0.81, 1.0], n)
        most = float(rng.choice([30.0, 100.0]))
        after = lambda i, o: np.floor((size[i] - o) * weight[i])  # noqa: E731, B023
        allowed = lambda i, j, o: (o * 100.0 <= most * size[i]) & (o < size[i])  # noqa: E731, B023
        for near in (True, False):
            given = (lo1, hi1, lo2, hi2, way, np.floor(size * weight), after, allowed, near)
            got, want = best_links(*given), all_pairs_chain(*given)
            assert [x.tolist() for x in got] == [list(map(type(x.tolist()[0]), w)) for x, w in zip(got, want)]


def test_global_chain_is_the_best_of_all_chains():
    from itertools import combinations

    from helixframe.operators import filters

    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        lo1, a2, size = np.sort(rng.integers(1, 80, n)), rng.integers(1, 80, n), rng.integers(3, 25, n)
        part = pd.DataFrame({"lo1": lo1, "hi1": lo1 + size - 1, "lo2": a2, "a2": a2, "z2": a2 + size - 1, "hi2": a2 + size - 1, "dir2": rng.choice([1, -1], n), "idy": rng.choice([80.0, 100.0], n), "aln_id": range(n)}).sort_values(["lo1", "lo2", "aln_id"], kind="stable")
        p = part.reset_index(drop=True)

        def worth(chain):
            total = 0
            for before, i in zip((None, *chain), chain):
                share = 0
                if before is not None:
                    if p.dir2[before] != p.dir2[i] or p.a2[before] > p.a2[i]:
                        return -1
                    share = max(p.hi1[before] - p.lo1[i] + 1, p.z2[before] - p.a2[i] + 1, 0)
                    if share >= p.hi1[i] - p.lo1[i] + 1:
                        return -1
                total += np.floor((p.hi1[i] - p.lo1[i] + 1 - share) * (p.idy[i] / 100) ** 2)
            return total

        chosen = np.flatnonzero(filters.global_chain(part))
        assert worth(chosen) == max(worth(c) for k in range(1, n + 1) for c in combinations(range(n), k))


def test_many_rows_in_one_group_are_chained_in_time():
    import time

    from helixframe.operators.chains import best_links

    rng = np.random.default_rng(6)
    n = 60_000
    lo1, lo2, size = np.sort(rng.integers(0, 10**8, n)), rng.integers(0, 10**8, n), rng.integers(20, 400, n)
    began = time.process_time()
    score, _, came = best_links(lo1, lo1 + size - 1, lo2, lo2 + size - 1, np.ones(n, np.int64), size, lambda i, o: size[i] - o, lambda i, j, o: o < size[i], True)
    assert (came >= 0).sum() > n // 2 and score.max() > 100 * size.mean()
    assert time.process_time() - began < 60  # 10**6 rows: some minutes


def all_rivals(start, size, place, group, beaten, before, after):
    """Each match with all of the group, one at a time."""
    for i, g in enumerate(group.tolist()):
        shared = np.minimum(start + size, start[i] + size[i]) - np.maximum(start, start[i])
        rival = shared >= np.minimum(size, size[i]) // 2
        beaten[g] |= bool((rival & (size > size[i])).any())
        twin = rival & (size == size[i])
        before[g] |= bool((twin & (place < place[i])).any())
        after[g] |= bool((twin & (place > place[i])).any())


@pytest.mark.parametrize("least", [1, 2])
def test_rivals_by_sweep_are_those_by_pairs(least):
    from helixframe.operators import cluster

    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(2, 30))
        start, size, place = np.sort(rng.integers(0, 40, n)), rng.integers(least, 14, n), rng.permutation(n)
        found = []
        for how in (cluster._rivals, all_rivals):
            flags = [np.zeros(n, bool) for _ in range(3)]
            how(start, size, place, np.arange(n), *flags)
            found.append([f.tolist() for f in flags])
        assert found[0] == found[1]


def test_many_matches_at_one_start_stay_small():
    import tracemalloc

    from helixframe.operators.cluster import thin

    rng = np.random.default_rng(8)
    n = 30_000
    m = np.column_stack([np.full(n, 5), rng.choice(10**7, n, replace=False), rng.integers(20, 60, n)])
    tracemalloc.start()
    kept = thin(m)
    assert 0 < len(kept) <= n and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
