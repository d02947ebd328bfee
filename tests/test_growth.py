"""Groups that are many or large: the same rows as from brute force, in time that grows with the rows."""

import time

import numpy as np
from pyspark.sql import functions as F


def test_many_small_pairs_are_chained_together(spark):
    from helixframe.operators import tiling

    n = 12000
    base = spark.range(n).select("id", F.lit("r").alias("ref_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("qry_id"), F.lit(1000).cast("long").alias("ref_len"), F.lit(100).cast("long").alias("qry_len"), F.lit(1).alias("dir2"), F.lit(99.0).alias("idy"))
    long = lambda x: F.lit(x).cast("long")
    first = base.select("*", long(961).alias("lo1"), long(1000).alias("hi1"), long(1).alias("lo2"), long(40).alias("hi2"))
    second = base.select("*", long(1).alias("lo1"), long(60).alias("hi1"), long(41).alias("lo2"), long(100).alias("hi2"))
    rows = first.unionByName(second).withColumn("aln_id", F.col("id") * 2 + (F.col("lo2") > 1).cast("long"))
    begin = time.time()
    found = tiling.chains(rows, circular=True).groupBy("start", "end", "covered").count().collect()
    assert [tuple(r) for r in found] == [(961, 1060, 100.0, n)]
    assert time.time() - begin < 60  # one call for each pair took over two minutes


def test_dense_intervals_are_chained_in_time():
    from helixframe.operators.filters import _chained_apart, best_chain

    r = np.random.default_rng(3)

    def dense(n, span, size):
        lo = r.integers(1, span, n)
        length, other = r.integers(1, size, n), r.integers(1, span, n)
        idy = (length - np.minimum(length, r.integers(0, 40, n))) * 100.0 / length
        order = np.lexsort((np.arange(n), -np.floor(length * (idy / 100.0) ** 2), lo))
        return [x[order] for x in (lo, lo + length - 1, idy, other, other + length - 1)]

    for _ in range(300):
        lo, hi, idy, olo, ohi = dense(int(r.integers(1, 60)), int(r.choice([5, 40, 400])), int(r.choice([2, 9, 80])))
        chosen = best_chain(lo, hi, idy, olo, ohi)
        score, gap, came = _chained_apart(lo, hi, (idy / 100.0) ** 2, olo, ohi, 100.0)  # each with each
        at, want = int(np.lexsort((gap, -score))[0]), np.zeros(len(lo), bool)
        while at >= 0:
            want[at], at = True, came[at]
        assert (chosen == want).all()
    begin = time.time()
    assert best_chain(*dense(60000, 6000, 2000)).any()
    assert time.time() - begin < 12  # each with those that it overlaps took 17 seconds


def test_lines_of_one_start_are_one_match_in_sql():
    import duckdb

    from helixframe.operators.cluster import _one_on_a_diagonal
    from helixframe.plans import catalog

    db = duckdb.connect()
    db.sql("CREATE TABLE lineitem AS SELECT ((i * 7919) % 4000)::BIGINT AS l_orderkey, (i % 2)::BIGINT AS l_partkey, (i % 3)::BIGINT AS l_suppkey, (1 + i % 7)::INT AS l_linenumber, (1 + (i * 31) % 50)::DOUBLE AS l_quantity FROM range(40000) t(i)")
    groups = db.sql("SELECT " + ", ".join(f"{how} AS {name}" for name, how in catalog._LINES.items()) + " FROM lineitem").df().groupby(["ref_id", "qry_id"])
    want = {(*key, *row) for key, part in groups for row in _one_on_a_diagonal(part[["s1", "s2", "len"]].to_numpy()).tolist()}
    found = db.sql(catalog._LINE_MEM + "SELECT ref_id, qry_id, s1, s2, len FROM mem").fetchall()
    assert len(found) == len(want) and set(found) == want


def test_records_of_many_alignments_are_read_in_parts():
    import pyarrow as pa

    from helixframe.sources import alignments

    n = 2 * alignments.AT_ONCE + 5
    record = "r q 100000 100000\n" + "\n".join(f"{i} {i + 9} {i} {i + 9} 0 0 0\n0" for i in range(1, n + 1))
    batch = pa.RecordBatch.from_arrays([pa.array(["ref.fa qry.fa\nNUCMER", record]), pa.array([0, 1], pa.int64())], names=["value", "ord"])
    parts = list(alignments._parsed(iter([batch]), "dna"))
    assert [p.num_rows for p in parts] == [alignments.AT_ONCE, alignments.AT_ONCE, 5]
    assert [s for p in parts for s in p.column("s1").to_pylist()] == list(range(1, n + 1))


def test_many_rows_of_a_pair_are_chained_as_each_with_each():
    from helixframe.operators import tiling
    from helixframe.operators.chains import best_links

    r = np.random.default_rng(9)
    for _ in range(300):
        n, span = int(r.integers(17, 60)), int(r.choice([20, 300]))
        lo1, lo2, way = np.sort(r.integers(1, span, n)), r.integers(1, span, n), r.choice([1, -1], n)
        size = r.integers(1, 40, n)
        hi1, hi2 = lo1 + r.integers(0, 40, n), lo2 + size - 1
        score, came = tiling._link_near(lo1, hi1, lo2, hi2, way, -1, 0)
        few = tiling._link_few(*(x.tolist() for x in (lo1, hi1, lo2, hi2, way)), -1, 0)
        fast = best_links(lo1, hi1, lo2, hi2, way, size, lambda i, over: size[i] - over, lambda i, _, over: over < size[i], near=False)
        assert score.tolist() == fast[0].tolist() == few[0] and came.tolist() == fast[2].tolist() == few[1]


def test_tiles_are_linked_over_small_batches(spark):
    from helixframe.operators import tiling

    r = np.random.default_rng(4)
    contigs = [(i, f"r{i % 3}", f"q{i:03d}", int(r.integers(1, 4000)), int(r.integers(20, 120))) for i in range(150)]
    rows = spark.createDataFrame([(i, ref, q, 5000, n, at, at + n - 1, 1, n, 1, 99.0) for i, ref, q, at, n in contigs], "aln_id long, ref_id string, qry_id string, ref_len long, qry_len long, lo1 long, hi1 long, lo2 long, hi2 long, dir2 int, idy double")
    want = set()
    for ref in ("r0", "r1", "r2"):
        tiles = sorted((at, at + n - 1, q) for _, own, q, at, n in contigs if own == ref)
        at = 0
        while at is not None:
            want.add((ref, *tiles[at]))
            inside = [k for k in range(at + 1, len(tiles)) if tiles[k][0] <= tiles[at][1] < tiles[k][1]]
            beyond = [k for k in range(at + 1, len(tiles)) if tiles[k][0] > tiles[at][1]]
            at = min(inside, key=lambda k: (-tiles[k][1], k)) if inside else beyond[0] if beyond else None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = [(t.ref_id, t.start, t.end, t.qry_id) for t in tiling.tiling(rows).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(want) and set(found) == want


def test_few_rows_of_many_pairs_are_many_tasks(spark):
    """Pairs' clusters are dealt by a fixed number, whatever the bytes, and are those of each pair alone (F4 and what clusters too)."""
    from helixframe.operators import cluster

    rows = [("r", f"q{k}", 1, 10 + 80 * i, 20 + 80 * i, 30 + k % 9) for k in range(300) for i in range(1 + k % 3)]
    df = spark.createDataFrame(rows, "ref_id string, qry_id string, strand int, s1 long, s2 long, len long")
    found = cluster.clusters(df, 60, 60)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    got = {}
    for r in found.orderBy("qry_id", "cluster_id", "ord").collect():
        got.setdefault(r.qry_id, []).append((r.cluster_id, r.ord, r.s1, r.s2, r.len, r.adj))
    assert got == {f"q{k}": [(0, i, 10 + 80 * i, 20 + 80 * i, 30 + k % 9, 0) for i in range(1 + k % 3)] for k in range(300) if k % 3}


def test_dashes_of_a_text_are_letters(spark):
    """Texts that hold dashes align, and their CIGAR and MD tell what differs."""
    from helixframe.operators import variants
    from helixframe.operators.extend import Options
    from helixframe.plans.align import align

    ref = "one well-known line of text that is long enough to be aligned, end-to-end, by any reader"
    qry = "aa " + ref.replace("long", "lengthy").replace("end-to-end", "end-to-e-nd") + " bb"
    columns = "seq_id string, ord long, seq string, len long"
    refs, queries = (spark.createDataFrame([(name, 0, seq, len(seq))], columns) for name, seq in (("r", ref), ("q", qry)))
    rows = align(refs, queries, Options(min_match=20, min_cluster=20, text=True, strand="forward", matches="all"))
    made = variants.sam_columns(variants.with_sequences(rows, refs, queries)).collect()
    assert len(made) == 1
    r = made[0]
    assert variants.replay(r.cigar, r.ref_seq, r.qry_seq) == (len(r.ref_seq), len(r.qry_seq), r.nm) and r.nm == r.errors
    assert variants.expand(r.ref_seq, r.qry_seq, r.deltas)[1].replace(variants.GAP, "") == r.qry_seq and "e-nd" in r.qry_seq


def test_alignments_are_made_once(spark):
    """What reads alignments several times reads written rows, and does not align again."""
    from helixframe.plans import catalog

    rows = catalog._aligned(spark, "/root/testdata/sf0.001")[2]
    assert rows.inputFiles() and all("/aligned-" in f for f in rows.inputFiles())


def test_sweeps_are_dealt_by_a_fixed_number(spark):
    """Few bytes of a shuffle are not one task, and counts are those of brute force."""
    from helixframe.operators import intervals

    r = np.random.default_rng(5)
    rows = [(k, f"g{k % 40}", int(a), int(a + n)) for k, (a, n) in enumerate(zip(r.integers(1, 60, 800), r.integers(0, 30, 800), strict=True))]
    df = spark.createDataFrame(rows, "aln_id long, g string, lo long, hi long")
    points = df.select("aln_id", "g", F.col("hi").alias("pos"))
    made = [intervals.depth(df, ["g"]), intervals.at_positions(points, df.select("g", "lo", "hi"), ["g"], "pos", "lo", "hi", "n"), intervals.unique_share(df, ["g"], "lo", "hi")]
    for found in made:
        assert found.select(F.spark_partition_id()).distinct().count() > 4
    by_group = {}
    for _, g, lo, hi in rows:
        for p in range(lo, hi + 1):
            by_group.setdefault(g, {}).setdefault(p, 0)
            by_group[g][p] += 1
    assert {(x.g, p, x.depth) for x in made[0].collect() for p in range(x.lo, x.hi + 1)} == {(g, p, n) for g, at in by_group.items() for p, n in at.items()}
    assert {(x.aln_id, x.n) for x in made[1].collect()} == {(k, by_group[g][hi]) for k, g, _, hi in rows}
    assert {(x.aln_id, x["unique"]) for x in made[2].collect()} == {(k, sum(by_group[g][p] == 1 for p in range(lo, hi + 1))) for k, g, lo, hi in rows}


def test_seeds_are_taken_from_few_texts_at_once():
    """A worker decodes a bounded number of texts, and all of them."""
    import pyarrow as pa

    from helixframe.operators import seeds

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["k"])
    parts = list(seeds.slices(iter([batch, batch.slice(0, 3)])))
    assert max(p.num_rows for p in parts) <= seeds.AT_ONCE and [x for p in parts for x in p.column(0).to_pylist()] == [*range(1000), 0, 1, 2]


def test_contigs_are_shuffled_once(spark):
    """Contigs without a pair of several alignments are laid out and ranked where one shuffle brought them (F30), and all as by brute force."""
    from helixframe.operators import tiling

    r = np.random.default_rng(6)
    rows = []
    for k in range(1500):
        for ref in r.choice(5, int(r.integers(1, 4)), replace=False).tolist():
            for _ in range(int(r.integers(1, 5)) if k % 50 == 0 else 1):
                lo1, lo2, size = int(r.integers(1, 900)), int(r.integers(1, 20)), int(r.integers(5, 80))
                rows.append((len(rows), f"r{ref}", f"q{k}", 1000, 100, lo1, lo1 + size - 1, lo2, lo2 + size - 1, int(r.choice([1, -1])), float(r.integers(850, 1000)) / 10.0))
    names = ["aln_id", "ref_id", "qry_id", "ref_len", "qry_len", "lo1", "hi1", "lo2", "hi2", "dir2", "idy"]
    pairs, want = {}, {}
    for row in sorted(rows, key=lambda x: (x[5], x[7], x[0])):
        pairs.setdefault((row[2], row[1]), []).append(dict(zip(names, row, strict=True)))
    for (qry, ref), some in pairs.items():
        values = [np.array([x[c] for x in some]) for c in ("lo1", "hi1", "lo2", "hi2", "dir2", "idy", "aln_id")]
        made = list(tiling._best_of_pair(values, 1000, 100, 1000, False, False))
        if len(some) == 1:
            made[3] = some[0]["idy"]
        want.setdefault(qry, []).append((qry, ref, *made))
    ranked = {qry: sorted(some, key=lambda x: (-x[4], -x[5], x[1])) for qry, some in want.items()}
    placed = set()
    for best, *rest in ranked.values():
        over = max(0, 1 - best[2]) + max(0, best[3] - 1000)
        inside = best[4] * 100 / (100 - over) if over < 100 else 0.0
        placed.add((*best, max(best[4], inside) >= 60 and best[5] >= 90 and best[4] - (rest[0][4] if rest else 0.0) >= 10))
    df = spark.createDataFrame(rows, "aln_id long, ref_id string, qry_id string, ref_len long, qry_len long, lo1 long, hi1 long, lo2 long, hi2 long, dir2 int, idy double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {tuple(x) for x in tiling.chains(df).collect()} == {x for some in want.values() for x in some}
        found = tiling.placements(df, coverage=60.0)
        assert {tuple(x) for x in found.collect()} == placed and len({x[-1] for x in placed}) == 2
        for left in (found, tiling.unusable(df, coverage=60.0)):
            left.collect()
            assert _shuffled(left._jdf.queryExecution().executedPlan()) < 1.5 * len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def _shuffled(plan) -> int:
    """Rows that a plan's shuffles wrote; one that is read again has no node of its own."""
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.getClass().getSimpleName() == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(_shuffled(children.apply(i)) for i in range(children.size()))


def test_letters_whose_upper_case_is_longer(spark):
    """A letter of one text alone that is two in upper case (ß) is one column of MD, differences and variants (F1)."""
    from helixframe.operators import variants
    from helixframe.operators.extend import Options
    from helixframe.plans.align import align

    ref = "eine lange zeile in der die straße genannt wird und dann noch mehr text bis zum schluß der zeile"
    qry = "aa " + ref.replace("straße", "strabe").replace("schluß ", "schlu ") + " bb"
    columns = "seq_id string, ord long, seq string, len long"
    refs, queries = (spark.createDataFrame([(name, 0, seq, len(seq))], columns) for name, seq in (("r", ref), ("q", qry)))
    rows = align(refs, queries, Options(min_match=12, min_cluster=20, text=True, strand="forward", matches="all"))
    met = variants.with_sequences(rows, refs, queries)
    r = variants.sam_columns(met).first()
    assert (r.ref_seq, r.nm, r.nm) == (ref, r.errors, 2) and variants.replay(r.cigar, r.ref_seq, r.qry_seq) == (len(ref), len(ref) - 1, 2)
    assert r.md == f"{ref.index('ß')}ß{ref.rindex('ß') - ref.index('ß') - 1}^ß{len(ref) - ref.rindex('ß') - 1}"
    differing = variants.differences(met, context=2)
    assert {(d.sub_r, d.sub_q, d.ctx_r) for d in differing.collect() if d.sub_q == "B"} == {("ß", "B", "RAßE ")}
    assert all(len(d.sub_r) == 1 and len(d.ctx_r) == len(d.ctx_q) == 5 for d in differing.collect())
    assert {(v.ref, v.alt) for v in variants.vcf_rows(differing, refs).collect()} >= {("ß", "B")}


def test_best_chains_are_streamed_in_bounded_memory(monkeypatch):
    """A chain over blocks and parts is that of each row with each, and holds what overlaps, not the sequence."""
    import tracemalloc

    from helixframe.operators import filters

    def dense(n, places, most, seed, gaps=0):
        rng = np.random.default_rng(seed)
        lo = np.sort(rng.integers(1, places, n)) + gaps * np.arange(n)
        hi, olo = lo + rng.integers(0, most, n), rng.integers(1, places, n)
        idy = rng.choice([80.0, 90.0, 95.0, 100.0], n)
        order = np.lexsort((-np.floor((hi - lo + 1) * (idy / 100.0) ** 2), lo))
        return [x[order] for x in (lo, hi, (idy / 100.0) ** 2, olo, olo + hi - lo)]

    monkeypatch.setattr(filters, "AT_ONCE", 7)
    for seed in range(60):
        rows = dense(60, 200 if seed % 2 else 40, 30, seed, gaps=(0, 3, 12)[seed % 3])
        score, gap, came = filters._chained_apart(*rows, 100.0)
        at, whole = int(np.lexsort((gap, -score))[0]), []
        while at >= 0:
            whole.append(at)
            at = came[at]
        parts, found, ids = filters.Parts(), [], np.arange(60)
        for a in range(0, 60, 11):
            z = min(a + 11, 60)
            found += parts.take([ids[a:z], *(x[a:z] for x in rows)], z == 60, 0 if z == 60 else int(rows[0][z]))
        assert sorted(np.concatenate(found).tolist()) == sorted(whole)

    monkeypatch.setattr(filters, "AT_ONCE", 1 << 12)
    rows, peaks = dense(80000, 160000, 300, 1), []
    for n in (20000, 80000):
        tracemalloc.start()
        parts = filters.Parts()
        for a in range(0, n, 4000):
            parts.take([np.arange(a, a + 4000), *(x[a : a + 4000] for x in rows)], a + 4000 == n, int(rows[0][a + 4000]) if a + 4000 < n else 0)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_best_chains_shuffle_alignments_once(spark):
    """Besides the one that tells the table's rows apart, there is one shuffle for each side, and nothing is written."""
    from helixframe.plans import catalog

    for name, most in (("qlis", 2), ("rlis", 2), ("one_to_one", 5)):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert 2 <= plan.count("Exchange hashpartitioning") <= most and "lineitem.parquet" in plan and "SortMergeJoin" not in plan and "Window" not in plan, name
