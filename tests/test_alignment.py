"""Clusters, extension, chains, differences and formats."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as fn
from helixframe.operators import cluster, coords, extend, filters, gaps, intervals, structure, tiling, variants
from helixframe.plans.align import align, difference_report
from helixframe.sinks import formats
from helixframe.sources import sequences
from helixframe.sources.alignments import SCHEMA, read_delta, with_bounds, with_identity


def bases(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


def frame(spark, seqs, name="x"):
    return spark.createDataFrame([(name, k, i, v, len(v), None) for i, (k, v) in enumerate(seqs.items())], sequences.SCHEMA)


@pytest.fixture(scope="module")
def planted():
    """A query that overlaps the reference's end, with two bases lost and one changed."""
    rng = random.Random(11)
    ref = bases(rng, 1000)
    part = list(ref[900:])
    part[70] = {"a": "c", "c": "g", "g": "t", "t": "a"}[part[70]]
    del part[50], part[30]
    return ref, "".join(part) + bases(rng, 900)


def test_planted_edits_are_found(spark, planted):
    ref, qry = planted
    o = extend.Options(min_match=10, min_cluster=20)
    for text, turned in ((qry, False), (fn.revcomp(qry), True)):
        rows = align(frame(spark, {"r": ref}), frame(spark, {"q": text}), o).collect()
        best = max(rows, key=lambda r: r.e1 - r.s1)
        assert (best.s1, best.errors) == (901, 3) and best.e1 >= 997
        assert len([d for d in best.deltas if d > 0]) == 2
        assert (best.s2 > best.e2) == turned


def test_cigar_replays(spark, planted):
    ref, qry = planted
    refs, queries = frame(spark, {"r": ref}), frame(spark, {"q": qry})
    rows = variants.with_sequences(align(refs, queries, extend.Options(min_match=10, min_cluster=20)), refs, queries)
    for r in variants.sam_columns(rows).collect():
        assert variants.replay(r.cigar, r.ref_seq, r.qry_seq) == (len(r.ref_seq), len(r.qry_seq), r.nm)
        assert r.nm == r.errors
    assert formats.sam_lines(variants.sam_columns(rows)).count() == rows.count()
    lines = variants.display(rows, 50).first().lines
    assert len(lines) % 3 == 0


def test_snps_and_vcf(spark, planted):
    ref, qry = planted
    refs, queries = frame(spark, {"r": ref}), frame(spark, {"q": qry})
    rows = align(refs, queries, extend.Options(min_match=10, min_cluster=20)).filter("s1 = 901")
    differing = variants.differences(variants.with_sequences(rows, refs, queries), context=2)
    found = variants.snps(differing, rows).orderBy("p1").collect()
    assert [r.sub_q for r in found].count(".") == 2 and all(r.con_r == 0 and r.con_q == 0 for r in found)
    assert all(len(r.ctx_r) == 5 for r in found)
    vcf = variants.vcf_rows(differing, refs).collect()
    assert sorted(len(v.ref) - len(v.alt) for v in vcf) == [0, 1, 1]
    for v in vcf:
        assert ref[v.pos - 1 : v.pos - 1 + len(v.ref)].upper() == v.ref


def test_affine_is_optimal_on_short_strings():
    from functools import cache

    rng = random.Random(5)
    o = extend.Options()

    def best(a, b):
        @cache
        def go(i, j, last):
            if i == len(a) and j == len(b):
                return 0
            out = [-(10**9)]
            if i < len(a) and j < len(b):
                out.append((o.good if a[i] == b[j] else o.bad) + go(i + 1, j + 1, "M"))
            if i < len(a):
                out.append((o.gap_more if last == "D" else o.gap_open) + go(i + 1, j, "D"))
            if j < len(b):
                out.append((o.gap_more if last == "I" else o.gap_open) + go(i, j + 1, "I"))
            return max(out)

        return go(0, 0, "M")

    for mode in [extend.TARGET, extend.FORCED] * 40:
        a, b = bases(rng, rng.randint(1, 9)), bases(rng, rng.randint(1, 9))
        x, y = (np.frombuffer(t.encode(), np.uint8) for t in (a, b))
        ops = extend.affine(x, y, o, mode)[2]
        one, two = extend.gapped(a, b, ops)
        score, last = 0, "M"
        for op, p, q in zip(ops, one, two, strict=True):
            score += (o.good if p == q else o.bad) if op == "M" else o.gap_more if op == last else o.gap_open
            last = op
        assert score == best(a, b), (a, b, one, two)
        assert variants.expand(a, b, variants.contract(one, two)) == (one, two)


def test_contigs_over_the_origin_of_a_circular_reference(spark):
    rows = [
        # over the origin, forwards and backwards, and one that lies within
        (1, "r", "fwd", 1000, 100, 951, 1000, 1, 50, 1, 100.0), (2, "r", "fwd", 1000, 100, 1, 50, 51, 100, 1, 100.0),
        (3, "r", "rev", 1000, 60, 971, 1000, 31, 60, -1, 100.0), (4, "r", "rev", 1000, 60, 1, 30, 1, 30, -1, 100.0),
        (5, "r", "mid", 1000, 80, 301, 340, 1, 40, 1, 100.0), (6, "r", "mid", 1000, 80, 341, 380, 41, 80, 1, 100.0),
    ]
    df = spark.createDataFrame(rows, "aln_id long, ref_id string, qry_id string, ref_len long, qry_len long, lo1 long, hi1 long, lo2 long, hi2 long, dir2 int, idy double")
    found = {r.qry_id: (r.start, r.end, round(r.covered), r.ori) for r in tiling.chains(df, max_gap=100, circular=True).collect()}
    assert found == {"fwd": (951, 1050, 100, "+"), "rev": (971, 1030, 100, "-"), "mid": (301, 380, 100, "+")}
    straight = {r.qry_id: r.covered for r in tiling.chains(df, max_gap=100).collect()}
    assert straight == {"fwd": 50.0, "rev": 50.0, "mid": 100.0}
    tiles = [(r.qry_id, r.start, r.end, r.gap) for r in tiling.tiling(df, circular=True, max_gap=100).orderBy("start").collect()]
    assert tiles == [("mid", 301, 380, 570), ("fwd", 951, 1050, 250)]


def letters(text):
    return np.frombuffer(text.encode(), np.uint8)


def noisy(rng, text, kept):
    return "".join(c if rng.random() < kept else rng.choice("acgt") * rng.randint(0, 3) for c in text)


def test_origins_found_again_give_the_same_operations():
    rng = random.Random(3)
    for n in range(60):
        a = bases(rng, rng.randint(0, 120))
        b = noisy(rng, a, 0.85) + bases(rng, rng.randint(0, 30))
        o = extend.Options(break_length=rng.choice([10, 40, 200]))
        for mode in (extend.BEST, extend.TARGET, extend.FORCED, extend.TO_END):
            whole = extend.affine(letters(a), letters(b), o, mode)
            assert all(extend.affine(letters(a), letters(b), o, mode, few) == whole for few in (300, 0))


def test_origins_take_little_memory():
    import tracemalloc

    rng = random.Random(8)
    a = bases(rng, 1500)
    b, o, seen = noisy(rng, a, 0.8), extend.Options(break_length=10**6), []
    for traced in (1 << 40, 0):
        tracemalloc.start()
        seen.append((extend.affine(letters(a), letters(b), o, extend.FORCED, traced), tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    assert seen[0][0] == seen[1][0] and seen[1][1] < 0.75 * seen[0][1]


def test_alignments_go_on_to_the_end_of_the_shorter_sequence():
    rng = random.Random(12)
    core, o = bases(rng, 80), extend.Options(break_length=60)
    long, short = core + "a" * 200, core + "cc"  # the last two letters lower the score
    for x, y, turned in ((long, short, False), (short, long, True)):
        assert extend.affine(letters(x), letters(y), o, extend.BEST) == (80, 80, "M" * 80, False)
        u, v, ops, reached = extend.affine(letters(x), letters(y), o, extend.TO_END)
        assert (u if turned else v) == 82 and ops == "M" * 82 and not reached
    # where the search ends before, the best place is taken
    short = core + "c" * 90
    assert extend.affine(letters(long), letters(short), o, extend.TO_END)[:2] == (80, 80)
    pad = bases(rng, 40)
    found = [[(41, 1, 80)]]
    ends = {to_end: extend.extend_pair(pad + core + "a" * 300, core + "cc", found, extend.Options(break_length=60, to_end=to_end))[0][:4] for to_end in (False, True)}
    assert ends == {False: (41, 120, 1, 80), True: (41, 122, 1, 82)}


def worth(ref, qry, row, o):
    """The score of an alignment, and that it covers what it says."""
    lo1, hi1, lo2, hi2, ops = row
    one, two = extend.gapped(ref[lo1 - 1 : hi1], qry[lo2 - 1 : hi2], ops)
    assert one.replace(extend.GAP, "") == ref[lo1 - 1 : hi1] and two.replace(extend.GAP, "") == qry[lo2 - 1 : hi2]
    score, last = 0, "M"
    for op, p, q in zip(ops, one, two, strict=True):
        score += (o.good if p == q else o.bad) if op == "M" else o.gap_more if op == last else o.gap_open
        last = op
    return score


def best_global(ref, qry, o):
    """The best score of an alignment of both whole strings, by rows."""
    low = -(10**9)
    rows = [[(low, low, low)] * (len(qry) + 1) for _ in range(len(ref) + 1)]
    rows[0][0] = (0, low, low)
    for i in range(len(ref) + 1):
        for j in range(len(qry) + 1):
            if i or j:
                m = max(rows[i - 1][j - 1]) + (o.good if ref[i - 1] == qry[j - 1] else o.bad) if i and j else low
                d = max(rows[i - 1][j][0] + o.gap_open, rows[i - 1][j][1] + o.gap_more, rows[i - 1][j][2] + o.gap_open) if i else low
                q = max(rows[i][j - 1][0] + o.gap_open, rows[i][j - 1][1] + o.gap_open, rows[i][j - 1][2] + o.gap_more) if j else low
                rows[i][j] = (m, d, q)
    return max(rows[-1][-1])


def test_alignments_join_backwards():
    """A cluster off the diagonal is the first one's target and can't be reached; the one on the diagonal reaches back."""
    rng = random.Random(21)
    joined = 0
    for _ in range(25):
        a, between, b, rest = bases(rng, 60), bases(rng, rng.randint(24, 40)), bases(rng, 60), bases(rng, 300)
        changed = [c if rng.random() < 0.8 else rng.choice("acgt") for c in between]
        if rng.random() < 0.5:
            del changed[rng.randrange(len(changed))]
        ref = a + between + b
        qry = a + "".join(changed) + b + rest
        gap = len(changed)
        # as if eight letters just after the first cluster matched far on in the query
        off = (60 + 9, 60 + gap + 95, 9)
        o = extend.Options(min_match=20, break_length=200)
        clusters = [[(1, 1, 60)], [off], [(61 + len(between), 61 + gap, 60)]]
        rows = extend.extend_pair(ref, qry, clusters, o)
        whole = max(rows, key=lambda r: r[1] - r[0])
        assert whole[:2] == (1, len(ref)) and whole[2] == 1 and whole[3] >= 60 + gap + 60
        at = 60 + gap + 60
        assert worth(ref, qry, (1, len(ref), 1, at, whole[4][: len(whole[4]) - (whole[3] - at)]), o) == best_global(ref, qry[:at], o)
        joined += 1
        # without the way back there are two
        assert len([r for r in extend.extend_pair(ref, qry, clusters[:2], o) if r[0] == 1]) == 1
    assert joined == 25


def test_extension_covers_planted_pairs():
    """Random edits between clusters, all orders of clusters given, no letter used twice on the way."""
    rng = random.Random(22)
    for _ in range(40):
        o = extend.Options(min_match=12, break_length=rng.choice([40, 200]))
        blocks, ref, qry, clusters = rng.randint(1, 5), "", "", []
        for _ in range(blocks):
            ref, qry = ref + bases(rng, rng.randint(0, 30)), qry + bases(rng, rng.randint(0, 30))
            same = bases(rng, rng.randint(12, 50))
            clusters.append([(len(ref) + 1, len(qry) + 1, len(same))])
            ref, qry = ref + same, qry + same
        rng.shuffle(clusters)
        rows = extend.extend_pair(ref, qry, clusters, o)
        for row in rows:
            worth(ref, qry, row, o)
        for c in clusters:
            s1, s2, size = c[0]
            assert any(r[0] <= s1 and s1 + size - 1 <= r[1] and r[2] <= s2 and s2 + size - 1 <= r[3] for r in rows)


def test_a_search_stops_when_the_score_no_longer_rises():
    rng = random.Random(23)
    o = extend.Options(break_length=40)
    code = lambda t: np.frombuffer(t.encode(), np.uint8)
    good = bases(rng, 50)
    # 30 letters of no kinship are 60 anti-diagonals, and 50 good ones don't make up for them
    a, b = good + "a" * 30 + good, good + "c" * 30 + good
    for mode in (extend.BEST, extend.TARGET):
        assert extend.affine(code(a), code(b), o, mode) == (50, 50, "M" * 50, False)
    u, v, ops, reached = extend.affine(code(a), code(b), o, extend.FORCED)
    assert (u, v, reached) == (130, 130, True)
    assert extend.affine(code(a), code(b), extend.Options(break_length=170), extend.TARGET)[3]
    assert extend.affine(code(good), code(good), o, extend.BEST) == (50, 50, "M" * 50, True)


@pytest.mark.parametrize("seed", range(4))
def test_a_pair_with_two_indels_and_a_substitution(spark, seed):
    """One letter lost on each side and one changed: errors and deltas are counted, whatever the random letters."""
    rng = random.Random(seed)
    ref = bases(rng, 1000)
    qry = ref[900:] + bases(rng, 900)
    ref = ref[:950] + ref[951:]
    qry = qry[:75] + qry[76:]
    qry = qry[:25] + ("c" if qry[25] == "a" else "a") + qry[26:]
    rows = align(frame(spark, {"r": ref}), frame(spark, {"q": qry}), extend.Options(min_match=10, min_cluster=15)).collect()
    best = [r for r in rows if r.s1 == 901]
    assert len(best) == 1 and (best[0].e1 >= 998 and best[0].s2 == 1 and best[0].errors <= 4 and len(best[0].deltas) == 2)


def test_iupac_and_translation():
    assert fn.compatible("r", "a") and fn.compatible("a", "r") and not fn.compatible("r", "k")
    assert fn.compatible("y", "b") and not fn.compatible("b", "y") and fn.compatible("n", "t") and fn.compatible("r", "d")
    assert fn.translate_frame("atggcctaa", 1) == "MA*" and fn.translate_frame(fn.revcomp("atggcctaa"), 4) == "MA*"
    assert fn.amino_acid("ctn") == "L" and fn.amino_acid("nnn") == "X"
    assert fn.mask_short_orfs("MA*LLLL*K", 3, "X") == "XXJLLLLJX"


@pytest.mark.parametrize("overlap", [100.0, 40.0])
def test_best_chains_part_by_part_are_those_of_the_whole(spark, overlap):
    rng = random.Random(41)
    rows = []
    for ref in range(6):
        at = 0
        for _ in range(60):
            at += rng.choice([0, 1, 3, 10, 25])  # ties, nested and lone alignments
            lo2, size = rng.randint(1, 300), rng.choice([1, 4, 9, 9, 20])
            rows.append((len(rows), f"r{ref}", f"q{rng.randint(0, 2)}", at + 1, at + size, lo2, lo2 + size - 1, rng.choice([60.0, 100.0, 100.0])))
    df = spark.createDataFrame(rows, "aln_id long, ref_id string, qry_id string, lo1 long, hi1 long, lo2 long, hi2 long, idy double")
    for on, name, found in (("ref_id", "is_r", filters.reference_best(df, max_overlap=overlap)), ("qry_id", "is_q", filters.query_best(df, max_overlap=overlap))):
        want = set()
        lo, hi, olo, ohi = ("lo1", "hi1", "lo2", "hi2") if on == "ref_id" else ("lo2", "hi2", "lo1", "hi1")
        for _, part in df.toPandas().groupby(on):
            part = part.assign(worth=-np.floor((part[hi] - part[lo] + 1) * (part.idy / 100.0) ** 2)).sort_values([lo, "worth", "aln_id"])
            best = filters.best_chain(*(part[c].to_numpy() for c in (lo, hi, "idy", olo, ohi)), max_overlap=overlap)
            want |= set(part.aln_id[best])
        got = found.collect()
        assert len(got) == len(rows) and {r.aln_id for r in got if r[name]} == want


def test_best_chain_is_the_best_of_all_chains():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        lo = np.sort(rng.integers(0, 60, n))
        hi = lo + rng.integers(5, 20, n)
        idy = rng.choice([90.0, 95.0, 100.0], n)
        order = np.lexsort((np.arange(n), -np.floor((hi - lo + 1) * (idy / 100) ** 2), lo))
        lo, hi, idy = lo[order], hi[order], idy[order]
        zero = np.zeros(n, np.int64)
        chosen = np.flatnonzero(filters.best_chain(lo, hi, idy, zero, zero, max_overlap=0.0))

        def score(chain):
            return sum(np.floor((hi[i] - lo[i] + 1) * (idy[i] / 100) ** 2) for i in chain)

        apart = [c for k in range(1, n + 1) for c in combinations(range(n), k) if all(hi[a] < lo[b] for a, b in zip(c, c[1:]))]
        assert score(chosen) == max(map(score, apart))


def test_clusters_trim_and_drop(spark):
    rows = [("r", "q", 1, 1, 1, 40), ("r", "q", 1, 61, 61, 40), ("r", "q", 1, 95, 97, 30), ("r", "q", 1, 5000, 9000, 20)]
    found = cluster.clusters(spark.createDataFrame(rows, "ref_id string, qry_id string, strand int, s1 long, s2 long, len long")).orderBy("ord").collect()
    assert {r.cluster_id for r in found} == {0}
    assert [(r.s1, r.s2, r.len, r.adj) for r in found] == [(1, 1, 40, 0), (61, 61, 40, 0), (101, 103, 24, 6)]
    kept = cluster.consistent_set(spark.createDataFrame(rows, "ref_id string, qry_id string, strand int, s1 long, s2 long, len long"))
    assert kept.filter("kept").count() == 4


def test_gap_errors():
    def slow(a, b):
        big = 10**9
        d = {(0, 0, "a"): 0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                for s in "aid":
                    if (i, j) == (0, 0):
                        continue
                    v = big
                    if s == "a" and i and j:
                        v = min(d.get((i - 1, j - 1, t), big) for t in "aid") + (a[i - 1] != b[j - 1])
                    if s == "i" and i:
                        v = min(d.get((i - 1, j, t), big) + 1 + (t != "i") for t in "aid")
                    if s == "d" and j:
                        v = min(d.get((i, j - 1, t), big) + 1 + (t != "d") for t in "aid")
                    d[i, j, s] = v
        return min(d.get((len(a), len(b), s), big) for s in "aid")

    rng = random.Random(6)
    for _ in range(200):
        a, b = bases(rng, rng.randint(0, 8)), bases(rng, rng.randint(0, 8))
        assert gaps.gap_errors(a, b) == slow(a, b), (a, b)
        if a and b:
            assert gaps._least_cost(*(np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, b))) == slow(a, b), (a, b)
    for _ in range(4):  # longer than the limit, with planted changes, against the full table
        a = bases(rng, 1500)
        b = a[:200] + bases(rng, rng.randint(0, 40)) + a[230:900] + a[901:1200] + bases(rng, 1) + a[1201:]
        table = gaps.gap_errors(a[:999], b[:999])
        assert gaps._least_cost(*(np.frombuffer(x[:999].encode("utf-32-le"), np.uint32) for x in (a, b))) == table
    a = bases(rng, 30_000)
    b = a[:5000] + "acgta" * 3 + a[5000:20_000] + a[20_007:]
    assert gaps.gap_errors(a, b) is None and gaps.gap_errors(a, a, None) == 0
    assert gaps.gap_errors(a, b, None) <= 16 + 8 and gaps.gap_errors(a, a + "c", None) == 2


def alignments(spark, rows):
    return with_bounds(with_identity(spark.createDataFrame([(i, r, q, 1000, 500, *c, e, e, 0, [], "dna") for i, (r, q, c, e) in enumerate(rows)], SCHEMA)))


def test_delta_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "r", "q", 100, 90, 1, 50, 1, 49, 2, 2, 0, [10, -3], "dna"), (2, "r", "q", 100, 90, 60, 80, 80, 60, 0, 0, 0, [], "dna"), (3, "r", "p", 100, 20, 5, 9, 1, 5, 0, 0, 0, [], "dna")], SCHEMA)
    formats.write_delta(rows, str(tmp_path / "d"), "ref.fa", "qry.fa")
    again = read_delta(spark, str(tmp_path / "d"))
    assert sorted(tuple(r)[1:] for r in again.collect()) == sorted(tuple(r)[1:] for r in rows.collect())
    spark.createDataFrame([(formats.delta_records(rows).count(),)], "n int").collect()


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACG\nTTn\n>two\n\n>three x\nggg*\n")
    rows = {r.seq_id: r.seq for r in sequences.read_sequences(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {"one": "acgttn", "two": "", "three": "ggg*"}
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n##\n")
    rows = {r.seq_id: (r.seq, r.qual) for r in sequences.read_sequences(spark, str(tmp_path / "a.fq")).collect()}
    assert rows == {"r1": ("acgt", "IIII"), "r2": ("gg", "##")}


def test_match_list_round_trip(spark, tmp_path):
    found = spark.createDataFrame([("r", "q", 1, 3, 4, 20), ("r", "q", -1, 7, 9, 25)], "ref_id string, qry_id string, strand int, s1 long, s2 long, len long")
    lines = formats.match_lines(found, frame(spark, {"q": "acgt", "p": "g"}))
    lines.select(F.array_join("lines", "\n").alias("value")).coalesce(1).write.text(str(tmp_path / "m"))
    again = formats.read_matches(spark, str(tmp_path / "m")).collect()
    assert sorted(map(tuple, again)) == [("q", -1, 7, 9, 25), ("q", 1, 3, 4, 20)]


def test_filters_in_order(spark):
    rows = alignments(spark, [("r", "q", (1, 100, 1, 100), 0), ("r", "q", (50, 149, 300, 399), 20), ("r", "p", (500, 599, 1, 100), 1)])
    assert filters.filtered(rows).count() == 3
    assert {r.aln_id for r in filters.filtered(rows, one=True).collect()} <= {r.aln_id for r in filters.filtered(rows, many=True).collect()}
    assert filters.filtered(rows, identity=90).count() == 2
    assert coords.selected(rows, 90).count() == filters.filtered(rows, identity=90).count()
    assert filters.filtered(rows, unique=60).count() == 1


def test_breakpoint_walk(spark):
    rows = alignments(spark, [("r", "q", (101, 200, 101, 200), 0), ("r", "q", (251, 350, 231, 330), 0), ("r", "q", (401, 450, 400, 351), 0), ("r", "p", (601, 700, 1, 100), 0)]).withColumn("is_r", F.lit(True)).withColumn("is_q", F.lit(True))
    kinds = [(r.type, r.start, r.end, r.len2) for r in structure.breakpoints(rows).orderBy("start").collect()]
    assert kinds == [("BRK", 1, 100, None), ("GAP", 201, 250, 30), ("INV", 351, 400, None), ("SEQ", 451, 600, None), ("BRK", 701, 1000, None)]


def test_tiling(spark):
    rows = alignments(spark, [("r", "a", (1, 500, 1, 500), 0), ("r", "b", (300, 799, 500, 1), 0), ("r", "c", (400, 899, 1, 500), 0), ("r", "d", (20, 60, 1, 41), 0)])
    tiles = tiling.tiling(rows).orderBy("start").collect()
    assert [(t.qry_id, t.ori) for t in tiles] == [("a", "+"), ("c", "+")] and tiles[0].gap == -101
    assert [r.qry_id for r in tiling.unusable(rows).collect()] == ["d"]
    contigs = frame(spark, {k: k * 500 for k in "abcd"})
    assert len(tiling.pseudomolecules(tiling.tiling(rows), contigs).first().seq) == 899


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 20, 30), ("a", 25, 26)], "k string, lo long, hi long")
    assert sorted((r.lo, r.hi, r.members) for r in intervals.union(rows, ["k"]).collect()) == [(1, 9, 2), (20, 30, 2)]
    assert intervals.covered(rows, ["k"]).first().covered == 20


def test_report_and_outputs(spark, planted):
    ref, qry = planted
    refs, queries = frame(spark, {"r": ref, "lone": "acgt"}), frame(spark, {"q": qry})
    rows = align(refs, queries, extend.Options(min_match=10, min_cluster=20)).persist()
    report = {(r.section, r.metric): r.value for r in difference_report(refs, queries, rows).collect()}
    assert report["ref_sequences", "unaligned_seqs"] == 1 and report["one_to_one", "alignments"] >= 1
    for df in (formats.coords_lines(coords.coords(rows)), formats.btab_lines(rows), formats.vcf_header(spark, refs), formats.sam_header(refs)):
        assert all(r.line for r in df.collect())


def test_six_frames(spark):
    from helixframe.operators.protein import align_protein, frames

    rng = random.Random(9)
    ref = bases(rng, 600)
    qry = fn.revcomp(ref[150:450])
    assert frames(frame(spark, {"r": ref})).count() == 6
    rows = align_protein(frame(spark, {"r": ref}), frame(spark, {"q": qry})).collect()
    long = max(rows, key=lambda r: abs(r.e1 - r.s1))
    assert long.hi1 - long.lo1 > 200 and (long.dir1 * long.dir2) == -1
    lo1, hi1, lo2, hi2 = long.lo1, long.hi1, long.lo2, long.hi2
    assert ref[lo1 - 1 : hi1] == fn.revcomp(qry[lo2 - 1 : hi2])


def test_listed_alignments(spark):
    rows = alignments(spark, [("r", "q", (1, 10, 5, 14), 0), ("r", "q", (1, 10, 5, 14), 0), ("r", "p", (20, 40, 60, 41), 1), ("s", "q", (1, 9, 1, 9), 0)])
    lines = ["1 10 | 5 14 | 10 10 | 100.00 | r q", "", "  20\t40 60 41 r p ", "1 10 5 14 r q"]
    text = lambda some: spark.createDataFrame([(x,) for x in some], "value string")
    assert sorted(r.aln_id for r in coords.listed(rows, text(lines)).collect()) == [0, 2]
    assert coords.listed(rows, text([])).count() == 0
    for wrong in ("1 10 5 15 r q", "1 10 5 r q", "a b c d r q"):
        with pytest.raises(Exception, match="alignment"):
            coords.listed(rows, text([*lines, wrong])).collect()
