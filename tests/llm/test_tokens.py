"""Token counts, the piece codec, packing and the id store against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import id_store, packing, piece_codec, token_counts

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ALPHABETS = ["ab c", "a \n<|endoftext|>é", "word  's \t x1", "aaaa", "漢字 a", "ΣΑς σΣ ", "the tion er é", "aé▁😀 ", "ing <s> </s> <unk> <0x41>\n", "\x00a b́\x1c\x85"]


def noise(rng, n):
    letters = rng.choice(ALPHABETS)
    return "".join(rng.choice(letters) if rng.random() < 0.97 else "<|endoftext|>" for _ in range(rng.randint(0, n)))


def library(path):
    return Tokenizer.from_file(path)


def test_huge_texts_are_spliced_exactly():
    rng, tok = random.Random(1), library(BYTES)
    for _ in range(250):
        text = noise(rng, 500)
        ids = [i for part in token_counts.encode_huge(text, tok, rng.choice([5, 20, 64]), rng.choice([2, 8, 16])) for i in part]
        assert ids == tok.encode(text, add_special_tokens=False).ids, text


def test_counts(odd, odd_rows, none):
    tok = library(BYTES)
    want = sorted((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 512) for i, t in odd_rows)
    assert sorted(map(tuple, token_counts.token_counts(odd, BYTES, chunk=3000, overlap=50).collect())) == want
    assert token_counts.token_counts(none, BYTES).count() == 0


def test_piece_codec_is_the_library():
    rng, codec = random.Random(2), piece_codec.codec(PIECES)
    for _ in range(800):
        text = noise(rng, 60)
        assert codec.encode(text) == codec.library.encode(text), text
        assert codec.tokens("▁" + text.replace(" ", "▁")) == codec.merged("▁" + text.replace(" ", "▁"))


def test_encode_decode(odd, odd_rows, none):
    import hashlib

    sp = piece_codec.codec(PIECES).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t in odd_rows)
    assert sorted(map(tuple, piece_codec.encode_decode(odd, PIECES).collect())) == want
    assert piece_codec.encode_decode(none, PIECES).count() == 0
    assert {r.doc_id: list(r.ids) for r in piece_codec.encoded(odd, PIECES).collect()}[1] == sp.encode("a b c d")


def optimum(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = random.Random(3)
    for _ in range(400):
        capacity = rng.choice([7, 10, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 8))]
        counts = {x: items.count(x) for x in set(items)}
        left = dict(counts)
        fixed = sum(n for _, n in packing.reduce_dominated(left, capacity))
        assert fixed + optimum([x for x, n in left.items() for _ in range(n)], capacity) == optimum(items, capacity)
        packed = {}
        for pattern, n in packing.pack_counts(counts, capacity):
            assert sum(pattern) <= capacity
            for x in pattern:
                packed[x] = packed.get(x, 0) + n
        assert packed == counts


def test_packing(odd, odd_rows, none):
    rows = packing.best_fit_packing(odd, BYTES, capacity=64).collect()
    tok = library(BYTES)
    pieces = {}
    for i, t in odd_rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            key = (i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            pieces[key] = pieces.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_packing(none, BYTES).count() == 0


def test_encoder_is_the_library():
    rng, tok, encode = random.Random(4), library(BYTES), packing.encoder(BYTES)
    for _ in range(300):
        text = noise(rng, 200)
        assert list(encode(text)) == tok.encode(text, add_special_tokens=False).ids, text


def test_store_encoding_is_the_library():
    rng, tok = random.Random(5), library(WORDS)
    texts = [noise(rng, 60) for _ in range(300)]
    assert [np.frombuffer(b, "<u2").tolist() for b in id_store.encode(texts, WORDS)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_encodes_slices_of_arrow_columns():
    tok = Tokenizer.from_file(WORDS)
    texts = ["left out", "Straße STRASSE straße", "", "  Ab aB\n\nAB ab ", "<|endoftext|> <|ENDOFTEXT|>", "don't DON'T İI K x.Y,z", "漢字é É", "left out"]
    for column in (pa.array(texts), pa.array(texts, pa.large_string())):
        found = id_store.encode(column.slice(1, 6), WORDS)
        assert [np.frombuffer(b, "<u2").tolist() for b in found] == [tok.encode(t, add_special_tokens=False).ids for t in texts[1:7]]
    assert id_store.encode(pa.array([], pa.string()), WORDS) == []


def test_chunks_are_found_again_after_an_insertion():
    ids = np.random.default_rng(6).integers(0, 40_000, 20_000).astype("<u2")

    def cut(x):
        ends = id_store.chunk_ends(x)
        return {x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)}

    ends = id_store.chunk_ends(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= id_store.GREATEST
    changed = np.concatenate([ids[:5000], ids[:7], ids[5000:]])
    assert len(cut(ids) & cut(changed)) > 0.8 * len(cut(ids))
    assert id_store.chunk_ends(ids[:0]) == []


def test_store_round_trip(spark, odd, odd_rows, none, tmp_path):
    path = str(tmp_path / "store")
    rows = sorted(map(tuple, id_store.through_store(odd, WORDS, path).collect()))
    tok, at, want = library(WORDS), 0, []
    for i, t in sorted(odd_rows, key=lambda x: x[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows == sorted(want)
    stored = spark.read.schema(id_store.RECIPE).parquet(f"{path}/recipes")
    digests = [bytes(g.digest) for r in stored.collect() for g in r.given]
    assert len(digests) == len(set(digests)) > 0
    assert id_store.through_store(none, WORDS).count() == 0


def test_damage_is_noticed(spark, odd, tmp_path):
    path = str(tmp_path / "store")
    id_store.write_store(odd, WORDS, path)
    rows = spark.read.schema(id_store.RECIPE).parquet(f"{path}/recipes").collect()
    rows = [r.asDict() | {"data": bytes(len(r.data))} for r in rows]
    spark.createDataFrame(rows, id_store.RECIPE).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(Exception, match="damaged"):
        id_store.read_store(spark, path).collect()


def test_merkle_roots_depend_on_order_and_content():
    assert id_store.merkle([b"a", b"b", b"c"]) != id_store.merkle([b"a", b"c", b"b"]) != id_store.merkle([b"a", b"c"])
