"""MinHash components, importance resampling and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import importance, lexical, minhash, near_copies

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return set() if not w else {" ".join(w)} if len(w) < n else {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def linked(rows, least=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and root[i] != root[j] and 100 * len(a & b) >= least * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    names = {}
    for (i, _), r in zip(rows, root):
        names[r] = i if names.get(r) is None else min(names[r], names[r] if i is None else i)
    return sorted(((i, len(s), names[r], i == names[r]) for (i, _), s, r in zip(rows, sets, root)), key=str)


def found(df):
    return sorted((tuple(r) for r in minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    for size, similarity in ((12, 0.5), (200, 0.8), (3000, 0.6)):
        same = []
        for _ in range(60):
            shared = round(2 * size * similarity / (1 + similarity))
            a = rng.integers(0, 1 << 63, size, np.uint64)
            b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, size - shared, np.uint64)])
            same.append((minhash.fast_sketch(a) == minhash.fast_sketch(rng.permutation(b))).mean())
        true = shared / (2 * size - shared)
        deviation = math.sqrt(true * (1 - true) / minhash.COORDINATES)
        assert abs(np.mean(same) - true) < 5 * deviation / math.sqrt(60) and np.std(same) < 1.5 * deviation


def test_every_bin_is_filled_whatever_the_set(monkeypatch):
    rng = np.random.default_rng(4)
    for size in (1, 2, 7, 160, 5000):
        hashes = rng.integers(0, 1 << 63, size, np.uint64)
        plain = minhash.fast_sketch(hashes)
        assert (plain < np.uint64(2 * minhash.COORDINATES << minhash.ORDER)).all()
        monkeypatch.setattr(minhash, "THROWN", 100)
        assert (minhash.fast_sketch(hashes) == plain).all()  # however many are thrown at once
        monkeypatch.undo()
    # by the definition: rounds one after another, until all bins are full
    hashes, low = rng.integers(0, 1 << 63, 30, np.uint64), (1 << minhash.ORDER) - 1
    bins = {}
    for i in range(2 * minhash.COORDINATES):
        for x in minhash._thrown(hashes, np.array([i]))[0].tolist():
            at = (x >> minhash.ORDER) * minhash.COORDINATES >> (64 - minhash.ORDER) if i < minhash.COORDINATES else i - minhash.COORDINATES
            bins[at] = min(bins.get(at, (9999, 0)), (i, x & low))
    assert minhash.fast_sketch(hashes).tolist() == [i << minhash.ORDER | x for i, x in (bins[k] for k in range(minhash.COORDINATES))]


def test_minhash_components(odd, odd_rows, none, spark):
    assert found(odd) == linked(odd_rows)
    assert minhash.near_duplicates(none).count() == 0
    empties = [(1, None), (2, ""), (3, " \n"), (None, None), (None, "a b c d e"), (9, "A b c d e"), (None, "x")]
    assert found(spark.createDataFrame(empties, "doc_id long, text string")) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True), (None, 2, 9, False), (9, 2, 9, True), (None, 1, None, True)], key=str)


def test_minhash_of_edited_and_hot_copies(spark, monkeypatch):
    """Pairs just above and below the threshold, a hot group in parts, and copies of one text."""
    monkeypatch.setattr(near_copies, "BLOCKED", 8)
    rng = random.Random(12)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows = []
    for _ in range(60):
        base = some(rng.randint(1, 150))
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = "x" + str(rng.random())
            rows.append(" ".join(copy))
    hot = some(120)
    for k in range(80):
        copy = list(hot)
        for _ in range(rng.randint(1, 7)):
            copy[rng.randrange(120)] = "y" + str(rng.random())
        rows.append(" ".join(copy))
    rows += [" ".join(hot)] * 50
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == linked(rows)


def resampled(docs, target, n, buckets, percent, least, seed=2024):
    grams = lambda text: [" ".join(w[i : i + k]) for w in [words(text)] for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in grams(text)) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        own = grams(text)
        weight = sum(gain[bucket(g)] for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    drawn = percent * len(able) // 100
    return sorted([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]], key=str)


@pytest.mark.parametrize("n, chunk", [(1, 1 << 16), (1, 50), (3, 40)])
def test_resampling(spark, odd, odd_rows, monkeypatch, n, chunk):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    rows = [*odd_rows, (None, "the ti on er " * 9), (77, "Ünï ti-on, ti " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = ["the ti on", None, "an an ber 7 ÜNÏ"]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in importance.resample(docs, aim, n=n, buckets=50, percent=60, least_words=10).collect()), key=str)
    assert got == resampled(rows, target, n, 50, 60, 10)
    assert sum(r[4] is not None for r in got) > 3
    assert sorted(r.doc_id for r in importance.resample(odd, aim).collect()) == sorted(i for i, _ in odd_rows)


def test_resampling_of_empty_tables(spark, none):
    aim = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert importance.resample(none, aim).count() == 0
    assert importance.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), aim.limit(0)).first().weight is not None


def test_chunks_own_each_start_once():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aé b.C\n7 ") for _ in range(rng.randint(0, 120)))
        n, size = rng.randint(1, 4), rng.randint(1, 30)
        pieces = list(importance.chunks(text, n, size))
        grams = lambda w, own: [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(own) if i + k <= len(w)]
        whole = words(text)
        assert Counter(g for p, own in pieces for g in grams(p.decode().split(), own)) == Counter(grams(whole, len(whole)))
        of, bucket, owned = importance.features(pa.array([p for p, _ in pieces], pa.binary()), np.array([o for _, o in pieces], np.int64), n, 1000)
        assert Counter(bucket.tolist()) == Counter(zlib.crc32(g.encode()) % 1000 for g in grams(whole, len(whole)))


def ranked(docs, items, k=20):
    own = [Counter(words(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in own]
    N, L = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, _), c, n in zip(docs, own, sizes):
            m = 75 + (25 * n * N) // L if L else 0
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if score > 0:
                scores.append((-score, i is not None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_search(spark, odd, odd_rows, none):
    rng = random.Random(6)
    syllables = ["an", "ber", "ti", "on", "the", "er", "zz", "é7", "Q"]
    prose = lambda n: " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(n))
    rows = [*odd_rows, (None, prose(5)), (None, prose(5)), *[(100 + i, prose(rng.randint(0, 60))) for i in range(300)]]
    rows += [(900 + i, "same Text here") for i in range(40)]
    items = [(1, prose(9)), (2, None), (3, ""), (4, "same here"), (4, "same here"), (None, prose(3)), (5, "nowhere at_all"), (6, prose(400)), (7, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = ranked(rows, items)
    for cells in (1 << 22, 60):
        assert sorted((tuple(r) for r in lexical.search(docs, asked, cells=cells).collect()), key=str) == want
    assert len(want) > 100 and lexical.search(none, asked).count() == 0 and lexical.search(docs, asked.limit(0)).count() == 0
    assert lexical.search(odd, asked).count() > 0


def test_bytes_bound_the_impacts():
    times, lengths = np.meshgrid(np.array([1, 2, 3, 50, 10**6]), np.array([1, 7, 100, 10**7]))
    exact = lexical.impacts(times.ravel(), lengths.ravel(), 1000, 90_000, 25, 12)
    level = -(-exact // lexical.STEP)
    assert level.max() <= 255 and (level * lexical.STEP >= exact).all() and (np.maximum(level - 1, 0) * lexical.STEP <= exact).all()
