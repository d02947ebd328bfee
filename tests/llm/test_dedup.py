"""SimHash components, exact dedup, quartile digests and sharding against brute force."""

import hashlib
import os
import random
import zlib

import pytest
import xxhash

import corpus_pipeline
from helixframe.llm import near_copies, quartile_digest, sharding, simhash, stream_dedup


def slow_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius):
    root = list(range(len(values)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_fingerprints_and_components(odd, odd_rows):
    rows = simhash.near_duplicates(odd, tree_size=4).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in rows) == sorted((i, f"{slow_fingerprint(t or ''):016x}") for i, t in odd_rows)
    groups = classes([slow_fingerprint(t or "") for _, t in odd_rows], 3)
    least = {}
    for (i, _), g in zip(odd_rows, groups):
        least[g] = min(i, least.get(g, i))
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted((i, least[g]) for (i, _), g in zip(odd_rows, groups))


def test_hot_shards_keep_every_link(spark):
    rng = random.Random(4)
    base, values = rng.getrandbits(64), set()
    while len(values) < 300:
        v = base
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(24)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.near_links(frame, 3, tree_size=16)).collect()}
    want = classes(values, 3)
    got = [found.get(simhash._signed(v), simhash._signed(v)) for v in values]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_bk_tree_search_is_exact():
    rng = random.Random(5)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree(values)
    for q in range(0, 4096, 37):
        assert {tree.values[i] for i in tree.search(q, 3)} == {v for v in values if (v ^ q).bit_count() <= 3}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(-5, -9)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert {found[i] for i in range(61)} == {0} and found[-5] == found[-9] == -9


def test_components_within_one_task_and_between_tasks(spark):
    rng = random.Random(8)
    nodes = rng.sample(range(-10_000, 10_000), 400)
    chains = [nodes[:250], nodes[250:390], nodes[390:]]
    pairs = [(a, b) for c in chains for a, b in zip(c, c[1:])]
    rng.shuffle(pairs)
    links = spark.createDataFrame(pairs, "a long, b long")
    want = {x: min(c) for c in chains for x in c}
    spark.sparkContext.setJobGroup("components", "")
    assert {r.node: r.root for r in simhash.components(links).collect()} == want
    # the driver's plans don't grow with the length of the chains
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 10
    spark.sparkContext.setJobGroup("others", "")
    assert {r.node: r.root for r in simhash.components(links, at_once=40).collect()} == want


def test_keep_one_keeps_columns(odd, odd_rows):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns
    # equal texts, A-Z or not, and the long text with a word more
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in odd_rows} - {2, 4, 6, 7, 8, 12})


def test_tree_search_in_shards_is_exact(spark):
    """Texts with a partner of another component within the radius, against brute force, with more trees than one a shard."""
    rng = random.Random(2)
    base = rng.getrandbits(512)
    rows = []
    for v in range(90):
        value = base
        for _ in range(rng.randint(0, 120)):
            value ^= 1 << rng.randrange(512)
        key = rng.randint(0, 2)
        rows.append((key, v, value.to_bytes(64, "big"), v % 3 if v < 40 else v, 200, bytes(near_copies.ODD // 8), [key] * near_copies.BANDS))
    frame = spark.createDataFrame(rows, "key long, vertex long, fp binary, root long, size long, odd binary, keys array<long>")
    got = {(r.key, r.vertex) for r in near_copies.promising(frame, 0.8, tree_size=8).collect()}
    main = {k: max((sum(r[0] == k and r[3] == root for r in rows), root) for root in {r[3] for r in rows})[1] for k in (0, 1, 2)}
    pairs = [(a, b) for a in rows for b in rows if a[0] == b[0] and a[3] != b[3] and (a[3] != main[a[0]] or b[3] != main[b[0]])
             and (int.from_bytes(a[2], "big") ^ int.from_bytes(b[2], "big")).bit_count() <= near_copies.RADIUS]
    assert got == {(r[0], r[1]) for pair in pairs for r in pair} and got


def similar_pairs(rows, shingle, least=0.8, widest=60):
    """Brute force: pairs of different texts whose sets are so similar, found through shingles that at most ``widest`` texts hold."""
    np = near_copies.np
    texts = {}
    for i, t in rows:
        texts.setdefault(near_copies.shingle_set(t or "", shingle).tobytes(), i)
    ids, sets = list(texts.values()), [np.frombuffer(s, np.uint64) for s in texts]
    every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    edges = np.flatnonzero(np.diff(every[order], prepend=0, append=0)) if len(order) else []
    met = set()
    for a, b in zip(edges, edges[1:]):
        if 2 <= b - a <= widest:
            some = of[order[a:b]].tolist()
            met.update((x, y) for k, x in enumerate(some) for y in some[k + 1 :])
    return {(ids[x], ids[y]) for x, y in met if near_copies.similarities(sets[x], [sets[y]])[0] >= least}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_near_dedup_finds_every_similar_pair_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    pairs = similar_pairs(docs.select("doc_id", "text").collect(), 5)
    assert len(pairs) == 48
    placed = docs.select("doc_id", near_copies._node().alias("node")).join(near_copies.classes(docs), "node")
    root = {r.doc_id: r.root for r in placed.select("doc_id", "root").collect()}
    assert all(root[a] == root[b] for a, b in pairs)


def test_near_copies_make_no_row_for_each_pair(spark, monkeypatch):
    """A hot group of texts below the similarity, some of them with partners beside the hubs, against brute force."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]

    def edited(words, places):
        words = list(words)
        for at in places:
            words[at] = "x" + str(rng.random())
        return words

    far = [edited(base, rng.sample(range(0, 120, 10), 3)) for _ in range(400)]
    texts = [" ".join(w) for w in far] + [" ".join(edited(far[k], [rng.choice([50, 51, 52])])) for k in range(0, 400, 20)]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    pairs = {(j, i) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    root = list(range(len(texts)))
    for j, i in sorted(pairs):
        if root[i] != root[j]:
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []

    def counting(map_, self, run, schema):
        rows = spark.sparkContext.accumulator(0)
        made.append(rows)

        def counted(batches):
            for b in run(batches):
                rows.add(b.num_rows)
                yield b

        return map_(self, counted, schema)

    plain = type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: counting(plain, self, run, schema))
    kept = sorted(r.doc_id for r in near_copies.keep_one(frame).collect())
    assert kept == sorted(set(root)) and len(kept) < len(texts)
    assert 0 < max(rows.value for rows in made) <= near_copies.BANDS * len(texts)


def test_parities_lose_no_similar_pair():
    rng = random.Random(6)
    for _ in range(300):
        one = {rng.getrandbits(64) for _ in range(rng.randint(1, 3000))}
        both = set(rng.sample(sorted(one), rng.randint(0, len(one)))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 400))}
        sets = [near_copies.np.array(sorted(x or {1}), near_copies.np.uint64) for x in (one, both)]
        bits = [near_copies.np.frombuffer(near_copies.parities(x), near_copies.np.uint64) for x in sets]
        differ = near_copies._differing(bits[0], bits[1][None])
        assert differ[0] <= len(set(sets[0].tolist()) ^ set(sets[1].tolist()))
        similar = near_copies.similarities(sets[0], [sets[1]])[0] >= 0.8
        assert not similar or near_copies._fits(differ, len(sets[0]), near_copies.np.array([len(sets[1])]), 0.8)[0]


def test_linked_texts_are_connected_whatever_the_trees(spark):
    """Parts of a shard, and of its texts a few in each, against all pairs of the shard."""
    rng = random.Random(8)
    base, rows = [rng.getrandbits(64) for _ in range(200)], []
    for v in range(80):
        hashes = near_copies.np.unique(near_copies.np.array([x if rng.random() > 0.05 + v % 4 / 50 else rng.getrandbits(64) for x in base], near_copies.np.uint64))
        fp = near_copies.sketch(hashes)[1]
        rows.append((7, v, v, len(hashes), fp, near_copies.parities(hashes), [7] + [v * 100 + k for k in range(1, near_copies.BANDS)], hashes.astype("<u8").tobytes()))
    frame = spark.createDataFrame(rows, "key long, vertex long, root long, size long, fp binary, odd binary, keys array<long>, set binary")
    decoded = [set(near_copies.np.frombuffer(r[7], "<u8").tolist()) for r in rows]
    near = lambda i, j: (int.from_bytes(rows[i][4], "big") ^ int.from_bytes(rows[j][4], "big")).bit_count() <= near_copies.RADIUS
    true = {(j, i) for i in range(80) for j in range(i) if len(decoded[i] & decoded[j]) >= 0.8 * len(decoded[i] | decoded[j]) and near(i, j)}
    for tree_size in (8, 1024):
        found = near_copies.promising(frame.drop("set"), 0.8, tree_size=tree_size)
        links = {(min(r), max(r)) for r in near_copies.linked(found, frame.select("vertex", "set"), 0.8, tree_size=tree_size).collect()}
        assert links <= true and 0 < len(links)
        assert classes_of(links, 80) == classes_of(true, 80) and len(set(classes_of(true, 80))) > 1
        if tree_size == 1024:
            assert len(links) < 80 < len(true)


def classes_of(pairs, n):
    root = list(range(n))
    for a, b in pairs:
        low, high = min(root[a], root[b]), max(root[a], root[b])
        root = [low if r == high else r for r in root]
    return root


def test_hot_keys_are_joined_where_they_are(spark):
    from helixframe.llm._shared import join_counted

    rows = spark.range(5000).selectExpr("id", "if(id % 2 = 0, 0, id) AS k")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k + 1 AS x")
    assert sorted(map(tuple, join_counted(rows, table, "k", "n", 5000).collect())) == sorted((i, k, 2500 if k == 0 else 1, k + 1) for i in range(5000) for k in [0 if i % 2 == 0 else i])


def test_near_dedup_stage_takes_five_words_and_similarity(spark):
    """Brute force over edited copies, a hot group of them and rows without an id or with one id."""
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    texts = []
    for _ in range(40):
        base = words(rng.randint(5, 200))
        for edits in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "x" + str(rng.random())
            texts.append(" ".join(copy))
    hot = words(150)
    texts += [" ".join([*hot[:k], "new" + str(k), *hot[k:]]) for k in range(60)] + ["a b", "A  b", "a c", "", " "]
    texts = list(dict.fromkeys(texts))
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert kept.columns == ["doc_id", "text"] and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    apart = [(None, texts[0]), (None, " ".join(words(30))), (7, " ".join(words(30))), (7, " ".join(words(30)))]
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame(apart, "doc_id long, text string"), "").count() == 4


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_exact_groups(spark, odd, odd_rows, tmp_path):
    got = lambda df, **k: sorted(tuple(r) for r in stream_dedup.exact_groups(df, **k).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got(odd) == exact(odd_rows)
    odd.repartition(5).write.parquet(str(tmp_path / "docs"))
    assert got(spark.read.parquet(str(tmp_path / "docs")), batch_bytes=1) == exact(odd_rows)


def test_full_bytes_decide_when_digests_collide(odd, odd_rows):
    from pyspark.sql import functions as F

    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))
    found = stream_dedup.exact_groups(odd, digest=weak)
    assert sorted(tuple(r) for r in found.collect()) == exact(odd_rows)


def test_keep_latest_and_state_goes_on(spark, odd, odd_rows, tmp_path):
    kept = stream_dedup.keep_latest(odd)
    assert kept.columns == odd.columns and sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t in odd_rows})
    landed, state, out = (str(tmp_path / x) for x in ("landed", "state", "out"))
    for doc_id in (1, 2):
        spark.createDataFrame([(b"d", doc_id, 0, doc_id)], stream_dedup.LANDED).write.mode("append").parquet(landed)
        stream_dedup.seen(spark, landed, state, out, stores=2)
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 2]


def test_digests(odd, odd_rows):
    rows = {}
    for r in quartile_digest.document_fingerprints(odd, parts=3).collect():
        rows.setdefault(r.doc_id, []).append(r)
    order = sorted(odd_rows, key=lambda x: (x[0], x[1] or ""))
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        text = t[: len(t) - half] + following[:half]
        r = rows[i].pop(0) if len(rows[i]) > 1 else rows[i][0]
        assert (r.n_chars, r.fingerprint) == (len(t), quartile_digest.digest(t))
        if i != 2:
            assert (r.edited_sha256, r.edited_fingerprint) == (hashlib.sha256(text.encode()).hexdigest(), quartile_digest.digest(text))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = quartile_digest.digest(odd_rows[5][1])
    assert quartile_digest.likeness(long, quartile_digest.digest(odd_rows[6][1])) > 0.9
    assert quartile_digest.likeness(long, long) == 1.0


def test_ranges_are_partitions_however_many(spark, monkeypatch):
    """More ranges than shuffle partitions, each in a task of its own, and the same rows."""
    from helixframe.llm import _shared

    rows = [(i * 7 % 997, "w" * (i % 50) + str(i)) for i in range(900)] + [(None, "x"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(str, quartile_digest.document_fingerprints(docs, parts=1).collect()))
    placed = quartile_digest.with_following(docs, parts=23)
    held = placed.rdd.mapPartitionsWithIndex(lambda k, rows: [(k, {r.part for r in rows})]).collect()
    assert len(held) > int(spark.conf.get("spark.sql.shuffle.partitions")) and all(parts <= {k} for k, parts in held) and sum(map(len, (p for _, p in held))) > 15
    assert sorted(map(str, quartile_digest.document_fingerprints(docs, parts=23).collect())) == few
    assert _shared.range_count(docs, most=500) == -(-sum(len(t) for _, t in rows) // 500)


def test_one_document_is_its_own_next(spark):
    row = quartile_digest.document_fingerprints(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1.0


def test_bucket_counts_do_not_depend_on_windows(monkeypatch):
    data = random.Random(2).randbytes(5000)
    whole = quartile_digest.bucket_counts(data)
    monkeypatch.setattr(quartile_digest, "WINDOW", 700)
    assert (quartile_digest.bucket_counts(data) == whole).all() and whole.sum() == 3 * 5000 - 2 - 3 - 3


def test_shards(odd, odd_rows):
    rows = sharding.minimax_shards(odd, shards=7).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert {r.law for r in rows} == {"bytes"} and {r.shard for r in rows} <= set(range(7))
    crc_shards, slots = {}, {}
    for r in rows:
        crc_shards.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in crc_shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_least_capacity_over_the_tree_of_keys(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    for _ in range(4):
        sizes = {rng.choice([rng.randint(-(2**63), 2**63 - 1), rng.randint(0, 40)]): rng.choice([1, 3, 50, 400]) for _ in range(120)}
        shards = rng.randint(1, 9)
        capacity, bounds = sharding.shard_bounds(spark.createDataFrame(list(sizes.items()), "key long, size long"), shards)
        assert capacity == sharding.least_capacity([sizes[k] for k in sorted(sizes)], shards) and len(bounds) < shards


def test_empty_tables(none):
    assert simhash.near_duplicates(none).count() == near_copies.keep_one(none).count() == 0
    assert stream_dedup.exact_groups(none).count() == stream_dedup.keep_latest(none).count() == 0
    assert quartile_digest.document_fingerprints(none).count() == sharding.minimax_shards(none).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "x"), (4, "a b c"), (None, "")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} >= {(None, 4), (4, 4)}
    assert {(r.doc_id, r.keep_id, r.kept) for r in stream_dedup.exact_groups(docs).collect()} >= {(None, 4, False), (4, 4, True)}
    assert quartile_digest.document_fingerprints(docs).count() == sharding.minimax_shards(docs, 2).count() == 4


def test_first_links_are_found_by_trees(spark):
    """A pair of the first step is linked only if a search by fingerprints finds it, and its sets are similar."""
    hashes = near_copies.np.arange(1, 101, dtype=near_copies.np.uint64)
    near, far = bytes(64), b"\xff" * 64
    rows = [(0, near, hashes), (1, near, hashes[:90]), (2, far, hashes[:91]), (3, near, hashes[:50]), (4, b"\x01" + bytes(63), hashes[5:])]
    sets = spark.createDataFrame([(v, h.astype("<u8").tobytes()) for v, _, h in rows], "vertex long, set binary")
    prints = spark.createDataFrame([(v, fp) for v, fp, _ in rows], "vertex long, fp binary")
    homes = spark.createDataFrame([(v, len(h), 7) for v, _, h in rows], "vertex long, size long, block long")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0), (4, 1)], "a long, b long")
    found = lambda *of: {tuple(r) for r in near_copies.similar(pairs, sets, homes, 0.8, *of).collect()}
    assert found(prints, near_copies.RADIUS) == {(1, 0), (4, 0), (4, 1)}
    assert found() == {(1, 0), (2, 0), (4, 0), (4, 1)}
