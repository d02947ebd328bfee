"""Exact matches against their definition on random strings."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions.sequence import revcomp
from helixframe.operators import matches, seeds


def brute(refs, queries, length):
    out = set()
    for r, x in refs.items():
        for q, y in queries.items():
            for i in range(len(x)):
                for j in range(len(y)):
                    if i and j and x[i - 1] == y[j - 1]:
                        continue
                    n = 0
                    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                        n += 1
                    if n >= length:
                        out.add((r, q, 1, i + 1, j + 1, n))
    return out


def frame(spark, seqs):
    return spark.createDataFrame([(k, v, len(v), i) for i, (k, v) in enumerate(seqs.items())], "seq_id string, seq string, len long, ord long")


def made(seed, n, size, letters="acg"):
    rng = random.Random(seed)
    return {f"s{i}": "".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for i in range(n)}


def occurrences(text, part):
    return sum(text.startswith(part, i) for i in range(len(text)))


@pytest.mark.parametrize("way", [10**9, 0])
def test_maximal_and_unique_matches(spark, way):
    refs, queries = made(1, 3, 30), made(2, 12, 25)
    found = matches.maximal_matches(frame(spark, refs), frame(spark, queries), 3, broadcast_letters=way).cache()
    rows = {tuple(r) for r in found.collect()}
    assert rows == brute(refs, queries, 3)
    in_refs = lambda s: sum(occurrences(x, s) for x in refs.values())
    once = {r for r in rows if in_refs(refs[r[0]][r[3] - 1 : r[3] - 1 + r[5]]) == 1}
    assert {tuple(r) for r in matches.reference_unique(found).collect()} == once
    both = {r for r in once if occurrences(queries[r[1]], refs[r[0]][r[3] - 1 : r[3] - 1 + r[5]]) == 1}
    assert {tuple(r) for r in matches.unique_matches(found).collect()} == both


def test_reverse_strand(spark):
    refs, queries = {"r": "aaccggttacgtacgg"}, {"q": revcomp("ccggttacg")}
    docs = frame(spark, queries)
    rows = matches.on_forward_strand(matches.maximal_matches(frame(spark, refs), docs, 9, "both"), docs).collect()
    assert [(r.strand, r.s1, r.s2, r.len) for r in rows] == [(-1, 3, 9, 9)]


def test_nucleotides_only_never_matches_other_letters(spark):
    refs, queries = {"r": "acgtnnacgtacg"}, {"q": "acgtnnacgtacg"}
    rows = matches.maximal_matches(frame(spark, refs), frame(spark, queries), 4, nucleotides_only=True).collect()
    assert {(r.s1, r.s2, r.len) for r in rows} == {(1, 1, 4), (7, 1, 4), (1, 7, 4), (7, 7, 7)}


def test_self_repeats_and_tandems(spark):
    seqs = {"t": "gg" + "act" * 5 + "tt"}
    found = matches.self_repeats(frame(spark, seqs), 4)
    want = {(i, j, n) for _, _, _, i, j, n in brute(seqs, seqs, 4) if i < j}
    assert {(r.s1, r.s2, r.len) for r in found.collect()} == want
    tandem = {(r.start, r.extent, r.unit) for r in matches.exact_tandems(found).collect()}
    assert (3, 15, 3) in tandem


def test_reverse_repeats_pair_each_stretch_once(spark):
    seq = "acgga" + "ttt" + revcomp("acgga")
    rows = [r for r in matches.self_repeats(frame(spark, {"s": seq}), 5, "reverse").collect()]
    assert rows and all(seq[r.s1 - 1 : r.s1 - 1 + r.len] == revcomp(seq[r.s2 - r.len : r.s2]) for r in rows)


@pytest.mark.parametrize("strand", ["forward", "both"])
def test_self_repeats_of_long_sequences_by_many_tasks(spark, strand, monkeypatch):
    monkeypatch.setattr(matches, "HOT_ROWS", 40)  # the tandem's seeds are dealt over a grid
    rng = random.Random(17)
    part = "".join(rng.choice("acgt") for _ in range(40))
    seqs = {
        "copies": part + "".join(rng.choice("acgt") for _ in range(60)) + part[5:] + revcomp(part) + part, "tandem": "acg" * 45 + "t" * 50, "none": "", "short": "acgt",
        "same": part + part, "twin": part + part, "across": "g" * 3 + part * 3,
    }
    df = frame(spark, seqs)
    for length in (8, 21):
        whole = sorted(map(tuple, matches.self_repeats(df, length, strand).collect()))
        assert sorted(map(tuple, matches.self_repeats(df, length, strand, task_letters=30).collect())) == whole and whole
    # stretches over the borders of pieces, which are glued
    long = {"l": (part * 3 + "".join(rng.choice("acgt") for _ in range(9000))) * 3}
    df = frame(spark, long)
    assert sorted(map(tuple, matches.self_repeats(df, 25, strand, task_letters=0).collect())) == sorted(map(tuple, matches.self_repeats(df, 25, strand).collect()))


def test_window_hashes_agree_with_equality():
    rng = random.Random(3)
    text = "".join(rng.choice("ab") for _ in range(400))
    for n in (1, 2, 3, 7, 16, 31):
        hashes = seeds.window_hashes(seeds.code_points(text), n)
        windows = [text[i : i + n] for i in range(len(text) - n + 1)]
        assert len(hashes) == len(windows)
        assert len({(h, w) for h, w in zip(hashes.tolist(), windows)}) == len(set(windows)) == len(set(hashes.tolist()))


def test_seeds_are_kept_and_read_again(spark, tmp_path):
    rows = seeds.extract(frame(spark, made(4, 5, 40)), 5)
    seeds.save(rows, str(tmp_path / "seeds"), 4)
    assert sorted(map(tuple, seeds.load(spark, str(tmp_path / "seeds")).select("seq_id", "pos", "kmer").collect())) == sorted(map(tuple, rows.collect()))


def test_equal_stretches_share_a_sampled_seed():
    rng = random.Random(7)
    for _ in range(150):
        length = rng.randint(1, 30)
        seed = rng.choice([seeds.seed_length(length), rng.randint(1, length)])
        core = "".join(rng.choice("acgt"[: rng.randint(1, 4)]) for _ in range(rng.randint(length, 3 * length)))
        texts = ["".join(rng.choice("acgt") for _ in range(rng.randint(0, 40))) + core + "".join(rng.choice("acgt") for _ in range(rng.randint(0, 40))) for _ in range(2)]
        found = []
        for t in texts:
            at = seeds.sampled_places(seeds.window_hashes(seeds.code_points(t), seed), length - seed + 1) - t.index(core)
            found.append(set(at[(at >= 0) & (at + seed <= len(core))].tolist()))
        shared = sorted(found[0] & found[1])
        gaps = [b - a for a, b in zip(shared, shared[1:])]
        span = length - seed + 1
        assert shared and shared[0] < span and len(core) - seed - shared[-1] < span and max(gaps, default=0) <= span


def test_sampling_leaves_few_rows(spark):
    texts = made(8, 4, 4000, "acgt")
    whole, some = seeds.extract(frame(spark, texts), 30).count(), seeds.sampled(frame(spark, texts), 30).count()
    assert whole / some > 0.8 * (30 - seeds.seed_length(30) + 2) / 2


@pytest.mark.parametrize("hot", [3, 10**9])
def test_frequent_seeds_and_borders_of_pieces(spark, monkeypatch, hot):
    """One seed in most rows of both sides, dealt over a grid or not, and pieces shorter than the matches."""
    monkeypatch.setattr(matches, "HOT_ROWS", hot)
    rng = random.Random(9)
    bits = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    refs = {f"r{i}": bits(rng.randint(0, 9)) + "acca" * 4 + bits(rng.randint(0, 30)) for i in range(4)} | {"a": "a" * 25}
    queries = {f"q{i}": bits(rng.randint(0, 9)) + "acca" * 3 + bits(9) for i in range(9)} | {"t": refs["r1"] * 2, "u": "a" * 17, "v": ""}
    want = sorted(brute(refs, queries, 6))
    assert sorted(map(tuple, matches.maximal_matches(frame(spark, refs), frame(spark, queries), 6, broadcast_letters=0).collect())) == want
    one, keyed = frame(spark, refs), matches._keyed(matches.strands(frame(spark, queries)))
    for seed, size in ((6, 5), (4, 11)):
        ours = seeds.sampled(one, 6, seed).toDF("ref_id", "s1", "kmer")
        theirs = seeds.sampled(keyed, 6, seed).toDF("way_id", "s2", "kmer")
        rows = matches.verified(matches.islands(matches._by_seed(ours, theirs), 6, seed), one, keyed, 6, size)
        assert sorted(map(tuple, rows.collect())) == want


def test_letters_of_stretches(spark):
    texts = made(10, 3, 60) | {"e": "é漢x" * 9}
    rows = [(k, s + 1, n, s % 3) for k, t in texts.items() for s in range(0, len(t), 5) for n in (1, 4, 23) if s + n <= len(t)] * 2
    df = spark.createDataFrame(rows, "ref_id string, s1 long, len long, other int")
    for size in (7, 1 << 14):
        got = matches.with_letters(df, frame(spark, texts), "ref_id", "s1", "letters", size)
        assert got.columns == ["ref_id", "s1", "len", "other", "letters"]
        assert sorted(map(tuple, got.collect())) == sorted((k, s, n, o, texts[k][s - 1 : s - 1 + n]) for k, s, n, o in rows)


def test_empty_tables(spark):
    none = frame(spark, {"x": ""}).limit(0)
    assert matches.maximal_matches(none, frame(spark, {"q": "acgt"}), 2).count() == 0
    assert matches.maximal_matches(frame(spark, {"q": "acgt"}), none, 2).count() == 0
    assert matches.find(frame(spark, {"q": "acgt"}), F.lit("gt")).first().pos == 3


@pytest.mark.parametrize("pattern", ["gt", "aa", "a.", "\\E", "\\Q", "(", "$"])
def test_find_takes_texts_and_columns(spark, pattern):
    rows = frame(spark, {"q": "acgt", "r": "aaaa.a.", "s": "x\\Ey\\E\\Q(($", "t": "", "u": pattern})
    want = sorted((r.seq_id, i + 1) for r in rows.collect() for i in range(len(r.seq)) if r.seq.startswith(pattern, i))
    for given in (pattern, F.lit(pattern), F.col("pattern")):
        found = matches.find(rows.withColumn("pattern", F.lit(pattern)), given)
        assert sorted((r.seq_id, r.pos) for r in found.collect()) == want
