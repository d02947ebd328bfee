"""Clusters of a pair by many tasks, against the same by one."""

import numpy as np
import pytest

from helixframe.operators import band, cluster
from helixframe.operators.components import components

CELLS = "ref_id string, qry_id string, strand int, s1 long, s2 long, len long"
KEYS = ["ref_id", "qry_id", "strand", "cluster_id", "ord", "s1", "s2", "len", "adj"]


def some(seed, n=600, pairs=3):
    rng = np.random.default_rng(seed)
    rows = set()
    for _ in range(n):
        s2 = int(rng.integers(1, 6000))
        s1 = max(1, s2 + int(rng.integers(-3, 4)) * int(rng.integers(0, 30)) + 200 * int(rng.integers(0, 3)))
        rows.add((f"r{rng.integers(0, pairs)}", "q", 1 if rng.integers(0, 4) else -1, s1, s2, int(rng.choice([4, 12, 20, 300]))))
    for k in range(12):  # copies of a tandem repeat, in one another's rows and columns
        for j in range(12):
            rows.add(("r0", "q", 1, 7000 + 10 * k, 7000 + 10 * j, 10 * (12 - max(k, j))))
    return sorted(rows)


def brute(rows, max_gap, diagonal, factor):
    groups = {}
    for r in rows:
        groups.setdefault(r[:3], []).append(r[3:])
    out = set()
    for key, group in groups.items():
        m = sorted(group, key=lambda x: (x[1], x[0]))
        root = list(range(len(m)))
        for i in range(len(m)):
            for j in range(i + 1, len(m)):
                apart = m[j][1] - m[i][1] - m[i][2]
                near = abs((m[j][1] - m[j][0]) - (m[i][1] - m[i][0])) <= max(diagonal, int(factor * apart))
                if apart <= max_gap and near and root[i] != root[j]:
                    low, high = sorted((root[i], root[j]))
                    root = [low if x == high else x for x in root]
        out |= {(*key, *x, m[root[i]][0], m[root[i]][1]) for i, x in enumerate(m)}
    return out


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1064)] + [(2000, x) for x in range(2001, 2100)] + [(7, 7)]
    least = {x: x for link in links for x in link}
    for _ in least:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    alone = {x for x in least} - {x for a, b in links if a != b for x in (a, b)}
    got = {(r.node, r.root) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(x, r) for x, r in least.items() if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [5, 8, 14])
def test_band_join(spark, bits):
    rows = [r for r in some(bits)]
    first = {(r[:5]): r for r in rows}  # one match at each start
    rows = list(first.values())
    got = {tuple(r) for r in band.connected(spark.createDataFrame(rows, CELLS), 60, 5, 0.12, tile_bits=bits).drop("axis").collect()}
    assert got == brute(rows, 60, 5, 0.12)


def test_without_repeats(spark):
    rows = some(11)
    got = {tuple(r) for r in band.without_repeats(spark.createDataFrame(rows, CELLS)).drop("axis").collect()}
    want = set()
    for key in {r[:3] for r in rows}:
        want |= {(*key, *map(int, m)) for m in cluster.thin(np.array([r[3:] for r in rows if r[:3] == key]))}
    assert got == want and len(want) < len(rows)


@pytest.mark.parametrize("by_extent", [False, True])
def test_clusters_in_many_tasks(spark, by_extent):
    df = spark.createDataFrame(some(5), CELLS)
    one = {tuple(r) for r in cluster.clusters(df, 60, 40, by_extent=by_extent).select(KEYS).collect()}
    many = {tuple(r) for r in band.clusters(df, 60, 40, by_extent=by_extent, tile_bits=7).select(KEYS).collect()}
    assert many == one and one
    assert band.clusters(df.limit(0)).count() == 0


def test_one_axis_of_all_references(spark):
    refs = spark.createDataFrame([("r0", 0, "a" * 500), ("r1", 1, "a" * 400), ("r2", 2, "a" * 50)], "seq_id string, ord int, seq string")
    # the query goes over the border from r0 to r1; in r2 it repeats a longer match of r1
    rows = [("r0", "q", 1, 440, 100, 40), ("r0", "q", 1, 482, 142, 19), ("r1", "q", 1, 3, 164, 60), ("r1", "q", 1, 70, 231, 45), ("r2", "q", 1, 5, 164, 30), ("r1", "q", -1, 9, 9, 10)]
    df = spark.createDataFrame(rows, CELLS)
    got = sorted(tuple(r) for r in band.clusters(df, 90, 70, refs=refs).select("ref_id", "cluster_id", "ord", "s1", "s2", "len").collect())
    assert got == [("r0", 0, 0, 440, 100, 40), ("r0", 0, 1, 482, 142, 19), ("r1", 0, 0, 3, 164, 60), ("r1", 0, 1, 70, 231, 45)]
    apart = {r.ref_id for r in band.clusters(df, 90, 70).collect()}
    assert apart == {"r1"}  # alone, r0's chain is too short


def test_one_axis_equals_one_long_reference(spark):
    rows = [r for r in some(8, pairs=3)]
    refs = [(f"r{i}", i, "a" * 8000) for i in range(3)]
    axis = {f"r{i}": i * 8001 for i in range(3)}
    long = [("all", q, s, s1 + axis[r], s2, n) for r, q, s, s1, s2, n in rows]
    where = {v: k for k, v in axis.items()}
    whole = cluster.clusters(spark.createDataFrame(long, CELLS), 60, 40).collect()
    want = {(where[(r.s1 - 1) // 8001 * 8001], r.strand, (r.s1 - 1) % 8001 + 1, r.s2, r.len, r.adj) for r in whole}
    got = band.clusters(spark.createDataFrame(rows, CELLS), 60, 40, refs=spark.createDataFrame(refs, "seq_id string, ord int, seq string"), tile_bits=9)
    assert {(r.ref_id, r.strand, r.s1, r.s2, r.len, r.adj) for r in got.collect()} == want and want


def test_alignment_by_many_tasks(spark):
    from helixframe.operators.extend import Options
    from helixframe.plans.align import align

    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("acgt"), 1500))
    cells = "seq_id string, ord long, seq string, len long"
    make = lambda seqs: spark.createDataFrame([(n, i, s, len(s)) for i, (n, s) in enumerate(seqs)], cells)
    refs = make([("a", base[:700]), ("b", base[700:])])
    queries = make([("q", base[:300] + "a" + base[300:650] + base[655:1500])])
    ends = lambda o: sorted((r.ref_id, r.s1, r.e1, r.s2, r.e2, r.errors, tuple(r.deltas)) for r in align(refs, queries, o).collect())
    plain = ends(Options())
    assert len(plain) == 2 and ends(Options(tiled=True)) == plain
    assert {r[0] for r in ends(Options(one_axis=True))} == {"a", "b"}


def test_matches_of_one_start_in_any_order(spark):
    """Which of equal starts comes first is left to the sort, and merged spills change it from one sort to the next."""
    rng = np.random.default_rng(7)
    rows = [("r", f"q{k % 3}", 1, int(d) + int(s), int(s), int(n)) for k, (d, s, n) in enumerate(zip(rng.choice([0, 40], 3000), 1 + 20 * rng.integers(0, 90, 3000), rng.integers(8, 24, 3000), strict=True))]
    want = {("r", q, 1, *map(int, m)) for q in ("q0", "q1", "q2") for m in cluster.thin(np.array([r[3:] for r in rows if r[1] == q]))}
    conf, bound = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(bound, "50")
    try:
        got = [tuple(r) for r in band.without_repeats(spark.createDataFrame(rows, CELLS).repartition(8)).drop("axis").collect()]
    finally:
        conf.remove(bound)
    assert len(got) == len(want) and set(got) == want
