"""Token ids as a content-addressed store.

Each document's ids and an end id are cut into chunks where a rolling hash of the last ids has its
low bits clear (with a least and a greatest chunk length), and a chunk is addressed by its digest.
A chunk that one place uses lies with its document; one that several places use is stored once in
a table of shared chunks. Documents are dealt into ranges of ``doc_id``, in ascending order within
and between the range files; ``start`` counts the ids of all documents before.

The store's folder holds Parquet files with binary columns:

* ``recipes``: ``doc_id, start, n_tokens, lengths`` (ids in each chunk, 32-bit little-endian), ``digests`` (a
  chunk's digest after another, 16 bytes each), ``data`` (the ids of the chunks that no other place
  uses, 16-bit little-endian), ``given`` (digest and ids of the shared chunks that are stored here),
  ``whole`` (nothing is shared), ``leaf`` (digest of the recipe), in ascending ``doc_id``;
* ``manifest``: for each bucket the Merkle root over its recipes in order, and their number; the
  bucket -1 has the root over the buckets' roots.

Reading joins the shared chunks to the documents that use them (the others are not moved), takes every chunk's digest again, rebuilds every document and
the Merkle roots, and fails if anything differs. Texts are encoded by segment: for this vocabulary
white space is dropped and nothing spans a space, so the ids of the parts between ASCII spaces are
the ids of the text; parts seen before are looked up.

Defined results: a null text counts as empty and is its end id alone; rows with a null ``doc_id``
come first; very long texts are encoded whole; rows of one ``doc_id`` follow each other in the order of their ids; an empty table
gives an empty store; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm._shared import doc_texts, range_count, range_cuts, shared_path

END_ID = 2
DIGEST = 16
#: Ids are stored as bytes that only an entropy coder makes smaller.
PACKED = "zstd"
WINDOW = 16
LEAST, MASK, GREATEST = 64, 255, 1024
#: Words whose ids a worker remembers before it starts afresh.
REMEMBERED = 1 << 20
#: Texts that are encoded at once.
ENCODED = 4096
#: A stem of Latin-1 letters, and signs that may follow it, but no apostrophe: two pre-tokens, the first one the same in either case.
LATIN, SIGN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_lexica: dict[str, Lexicon] = {}
_tokenizers: dict[str, object] = {}
_stem_encoders: dict[str, tuple] = {}


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        if _tokenizers[path].get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
    return _tokenizers[path]


def _written(stem: bytes, final: bool) -> str | None:
    """Symbols of a-z and of the two-byte letters ß to ÿ as one ASCII sign each, the last symbol of a word as another one."""
    if not all(97 <= byte <= 122 or byte == 0xC3 or 0x9F <= byte <= 0xBF for byte in stem) or final and stem.endswith(b"\xc3"):
        return None
    inner = stem.translate(SIGNS).decode()
    return inner[:-1] + LAST_SIGN[stem[-1]] if final and inner else inner


WORD_END = r"[a-z\x00-\x1f@\[]*[A-Z\x20-\x3f\]]"
#: Bytes of inner letters: 0xC3 starts a two-byte letter, 0x9F to 0xBF end it.
SIGNS = bytes.maketrans(bytes([0xC3, 0x9F, *range(0xA0, 0xC0)]), b"@[" + bytes(range(32)))
LAST_SIGN = {c: chr(c - 32) for c in range(97, 123)} | {c: chr(c - 0x80) for c in range(0xA0, 0xC0)} | {0x9F: "]"}
LAST = [chr(c) for c in [*range(97, 123), *range(0xDF, 0x100)]]
LAST_LETTERS, LAST_WRITTEN = pa.array(LAST, pa.large_string()), pa.array([_written(c.encode(), True) for c in LAST], pa.large_string())


def _stems(path: str):
    """An encoder of many words of Latin-1 letters at once, and which ids end a word."""
    if path not in _stem_encoders:
        import json

        import tiktoken

        from helixframe.llm.packing import _byte_symbols

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, symbols, ranks = model["end_of_word_suffix"], _byte_symbols(), {}
        ends = set()
        for token, i in model["vocab"].items():
            stem = token.removesuffix(suffix)
            if all(c in symbols for c in stem) and (written := _written(bytes(symbols[c] for c in stem), stem != token)):
                ranks[written.encode()] = i
                if stem != token:
                    ends.add(i)
        last = np.zeros(max(ranks.values()) + 1, bool)
        last[list(ends)] = True
        # single bytes that no word has need an id as well
        ranks |= {bytes([b]): len(last) + b for b in range(256) if bytes([b]) not in ranks}
        _stem_encoders[path] = tiktoken.Encoding("stems", pat_str=WORD_END, mergeable_ranks=ranks, special_tokens={}), last
    return _stem_encoders[path]


def _encode_stems(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lower-cased words of Latin-1 letters, one after another, and how many each has."""
    plan, last = _stems(path)
    ends = pc.index_in(pc.utf8_slice_codeunits(words, -1, None), value_set=LAST_LETTERS)
    written = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, -1), LAST_WRITTEN.take(ends), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(written.buffers()[1], np.int64, len(written) + 1, 8 * written.offset)
    data = written.buffers()[2]
    letters = bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data else b""
    ids = plan.encode_to_numpy(letters.translate(SIGNS).decode("ascii"))
    return ids.astype(np.uint16), np.diff(np.flatnonzero(last[ids]), prepend=-1)


def _gathered(table: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``table`` one after another."""
    ends = np.cumsum(sizes)
    return table[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]


class Lexicon:
    """The words seen so far with their ids, in arrays: a word is looked at once however many slices of texts have it."""

    def __init__(self, path: str):
        self.path, self.words = path, pa.array([], pa.large_string())
        self.table, self.begins, self.sizes = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rare: dict[str, int] = {}

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of the distinct ``words`` is; those not seen before are added."""
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if new.any():
            at[new] = self._learnt(words.filter(pa.array(new)))
        return at

    def _added(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        first = len(self.words)
        self.words = pa.concat_arrays([self.words, words])
        self.begins = np.concatenate([self.begins, len(self.table) + np.cumsum(sizes) - sizes])
        self.table, self.sizes = np.concatenate([self.table, ids]), np.concatenate([self.sizes, sizes])
        return np.arange(first, len(self.words))

    def _by_library(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.rare))
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            ids = [e.ids for e in _tokenizer(self.path).encode_batch_fast(some, add_special_tokens=False)]
            places = self._added(pa.array(some, pa.large_string()), np.array([i for x in ids for i in x], np.uint16), np.array([len(x) for x in ids], np.int64))
            self.rare |= dict(zip(some, places.tolist(), strict=True))
        return np.array([self.rare[w] for w in words], np.int64)

    def _learnt(self, words: pa.Array) -> np.ndarray:
        at = np.zeros(len(words), np.int64)
        stem = pc.utf8_rtrim(words, SIGN)
        latin = pc.match_substring_regex(stem, LATIN).to_numpy(zero_copy_only=False)
        at[~latin] = self._by_library(words.filter(pa.array(~latin)).to_pylist())
        if not latin.any():
            return at
        whole, stem = words.filter(pa.array(latin)), stem.filter(pa.array(latin))
        signs = (pc.utf8_length(whole).to_numpy() - pc.utf8_length(stem).to_numpy()).astype(np.int64)
        stem = pc.utf8_lower(stem)
        numbered = stem.dictionary_encode()
        known = pc.index_in(numbered.dictionary, value_set=self.words)
        fresh = known.is_null().to_numpy(zero_copy_only=False)
        places = known.fill_null(-1).to_numpy().astype(np.int64)
        if fresh.any():
            unseen = numbered.dictionary.filter(pa.array(fresh))
            places[fresh] = self._added(unseen, *_encode_stems(unseen, self.path))
        own = places[numbered.indices.to_numpy()]
        # words that are not a stem themselves: the ids of the stem, and those of the signs after it
        rest = np.full(len(whole), -1, np.int64)
        for n in np.unique(signs[signs > 0]).tolist():
            some = signs == n
            rest[some] = self._by_library(pc.utf8_slice_codeunits(whole.filter(pa.array(some)), -n, None).to_pylist())
        other = pc.not_equal(whole, stem).to_numpy(zero_copy_only=False)
        both = np.stack([own[other], rest[other]], axis=1).reshape(-1)
        begins, sizes = self.begins[both], np.where(both < 0, 0, self.sizes[both])
        own[other] = self._added(whole.filter(pa.array(other)), _gathered(self.table, begins, sizes), sizes.reshape(-1, 2).sum(axis=1))
        at[latin] = own
        return at


def encoded(texts: list[str] | pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts one after another, without special tokens being added, and where each text begins and the last one ends."""
    if path not in _lexica or len(_lexica[path].words) >= REMEMBERED:
        _lexica[path] = Lexicon(path)
    known = _lexica[path]
    whole = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    parts = pc.split_pattern(pc.replace_substring(whole, "\n", " "), " ")
    numbered = parts.flatten().dictionary_encode()
    # words of ASCII letters have their ids by their lower-cased form, found without a look at each of them
    words = numbered.dictionary
    plain = pc.and_(pc.utf8_is_alpha(words), pc.string_is_ascii(words))
    folded = pc.if_else(plain, pc.ascii_lower(words), words).dictionary_encode()
    which = known.places(folded.dictionary)[folded.indices.to_numpy()][numbered.indices.to_numpy()]
    n = known.sizes[which]
    return _gathered(known.table, known.begins[which], n), np.concatenate([[0], np.cumsum(n)])[parts.offsets.to_numpy()]


def encode(texts: list[str] | pa.Array, path: str) -> list[bytes]:
    """The ids of each whole text as a 16-bit little-endian string."""
    ids, bounds = encoded(texts, path)
    data, at = ids.astype("<u2").tobytes(), (2 * bounds).tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def _gear(ids: np.ndarray) -> np.ndarray:
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def marks(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """After which places of the documents between ``bounds`` the hash of the last ``WINDOW`` ids has its low bits clear.

    The hash of a window is that of its halves: each pass doubles the window, which never reaches back beyond its document.
    """
    rolled, starts, width = _gear(ids), bounds[:-1], 1
    while width < WINDOW:
        older = np.zeros_like(rolled)
        older[width:] = rolled[:-width] << np.uint64(width)
        begin = (starts[:, None] + np.arange(width)).reshape(-1)
        older[begin[begin < len(ids)]] = 0
        rolled += older
        width *= 2
    return np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def _ends(places: list[int], begin: int, end: int) -> list[int]:
    """Where the chunks from ``begin`` to ``end`` end, given the marks between."""
    ends = []
    for mark in [*places, end]:
        while mark - begin > GREATEST:
            begin += GREATEST
            ends.append(begin)
        if mark - begin >= LEAST or mark == end and mark > begin:
            ends.append(mark)
            begin = mark
    return ends


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Where the chunks of ``ids`` end; a place depends on the ids just before it and on where the chunk began."""
    return _ends(marks(ids, np.array([0, len(ids)])).tolist(), 0, len(ids))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over ``leaves`` in order: pairs are hashed level by level, an odd one goes up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _leaf(doc_id: int | None, start: int, lengths: bytes, digests: bytes) -> bytes:
    return digest(repr((doc_id, start)).encode() + lengths + digests)


CUT = "bucket int, doc_id long, n_tokens long, lengths binary, digests binary, data binary"


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    """Stretches of ``data``, from the first to the last of ``ends``, as an Arrow column."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def cut_documents(docs: DataFrame, vocabulary: str, cuts: list[int], end_id: int = END_ID) -> DataFrame:
    """Each document's ids, the lengths and digests of its chunks, and its range of ``doc_id``."""
    borders = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ENCODED):
                b = whole.slice(at, ENCODED)
                ids, bounds = encoded(b.column(1), vocabulary)
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
                places, chunks, counts = marks(ids, bounds), [0], [0]
                of, begins = np.searchsorted(places, bounds, "right").tolist(), bounds.tolist()
                places = places.tolist()
                for k in range(b.num_rows):
                    chunks += _ends(places[of[k] : of[k + 1]], begins[k], begins[k + 1])
                    counts.append(len(chunks) - 1)
                data = ids.astype("<u2").tobytes()
                digests = b"".join([digest(data[2 * x : 2 * y]) for x, y in zip(chunks, chunks[1:], strict=False)])
                number = np.searchsorted(borders, b.column(0).fill_null(-(1 << 63)).to_numpy(), "right")
                n = np.array(counts)
                columns = [pa.array(number, pa.int32()), b.column(0), pa.array(np.diff(bounds), pa.int64()), _binary(np.diff(chunks).astype("<i4").tobytes(), 4 * n), _binary(digests, DIGEST * n), _binary(data, 2 * bounds)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "doc_id", "n_tokens", "lengths", "digests", "data"])

    return doc_texts(docs).mapInArrow(run, CUT)


EACH_DIGEST = f"transform(sequence(1, length(digests) div {DIGEST}), i -> substring(digests, {DIGEST} * (i - 1) + 1, {DIGEST}))"
GIVEN = "array<struct<digest: binary, data: binary>>"
RECIPE = f"doc_id long, start long, n_tokens long, lengths binary, digests binary, data binary, given {GIVEN}, whole boolean, leaf binary, bucket int"


def write_store(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Write the store of ``docs`` to ``path``, a folder that all executors reach."""
    spark = docs.sparkSession
    texts = doc_texts(docs)
    parts = parts or range_count(texts)
    cuts = range_cuts(texts.filter("doc_id is not null"), "doc_id", parts)
    staged = f"{path}/staged"
    cut_documents(docs, vocabulary, cuts, end_id).write.option("compression", PACKED).parquet(staged)
    made = spark.read.schema(CUT).parquet(staged)
    # digests alone move here
    uses = made.select("bucket", "doc_id", F.explode(F.expr(EACH_DIGEST)).alias("digest"))
    common = uses.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper")).filter("n > 1").select("digest", "keeper")
    listed = lambda what: F.unhex(F.array_join(F.sort_array(F.collect_set(what)), ""))
    name = F.hex("digest")
    hold = uses.join(common, "digest").groupBy("bucket", "doc_id").agg(listed(name).alias("out"), listed(F.when(F.col("doc_id").eqNullSafe(F.col("keeper")), name)).alias("give"))
    marked = hold.select("bucket", "doc_id", F.lit(0).alias("kind"), "out", "give")
    totals = made.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()  # one row a range
    begins, at = {}, 0
    for r in sorted(totals, key=lambda r: r["bucket"]):
        begins[r["bucket"]], at = at, at + r["n"]
    nothing = lambda *kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds]
    rows = marked.select("*", *nothing(("n_tokens", "long"), ("lengths", "binary"), ("digests", "binary"), ("data", "binary")))
    rows = rows.unionByName(made.select("bucket", "doc_id", F.lit(1).alias("kind"), *nothing(("out", "binary"), ("give", "binary")), "n_tokens", "lengths", "digests", "data"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Take the shared chunks out of the documents' bytes, count ``start`` on, and give each recipe its Merkle leaf."""
        bucket, start, held_for, shared, give = None, 0, None, set(), set()
        parted = lambda joined: {joined[i : i + DIGEST] for i in range(0, len(joined), DIGEST)}
        for b in batches:
            done = []
            for p, doc_id, kind, out, gives, n, lengths, digests, data in zip(*[b.column(i).to_pylist() for i in range(9)], strict=True):
                if p != bucket:
                    bucket, start = p, begins[p]
                if kind == 0:
                    held_for, shared, give = (p, doc_id), parted(out), parted(gives)
                    continue
                kept, given = data, []
                if held_for == (p, doc_id):
                    kept, at = [], 0
                    for k, length in enumerate(np.frombuffer(lengths, "<i4").tolist()):
                        key, chunk = digests[DIGEST * k : DIGEST * (k + 1)], data[at : at + 2 * length]
                        at += 2 * length
                        if key not in shared:
                            kept.append(chunk)
                        elif key in give:  # once
                            give.remove(key)
                            given.append({"digest": key, "data": chunk})
                    kept = b"".join(kept)
                done.append((doc_id, start, n, lengths, digests, kept, given, len(kept) == len(data), _leaf(doc_id, start, lengths, digests), p))
                start += n
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())])), pa.bool_(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "lengths", "digests", "data", "given", "whole", "leaf", "bucket"])

    ordered = rows.select("bucket", "doc_id", "kind", "out", "give", "n_tokens", "lengths", "digests", "data").repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "kind", "digests")
    recipes = ordered.mapInArrow(own, RECIPE)
    recipes.write.option("compression", PACKED).parquet(f"{path}/recipes")
    _manifest(spark, path).write.parquet(f"{path}/manifest")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """A Merkle root for each range of recipes, from the leaves in the files, and one over the ranges."""
    leaves = spark.read.schema(RECIPE).parquet(f"{path}/recipes").select("bucket", "start", "leaf")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = {}
        for b in batches:
            for p, leaf in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                found.setdefault(p, []).append(leaf)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([len(x) for x in found.values()], pa.int64()), pa.array([merkle(x) for x in found.values()], pa.binary())], names=["bucket", "documents", "root"])

    ranges = leaves.repartition("bucket").sortWithinPartitions("bucket", "start").mapInArrow(roots, "bucket int, documents long, root binary")
    known = sorted((r["bucket"], r["documents"], bytes(r["root"])) for r in ranges.collect())  # one row a range
    return spark.createDataFrame([*known, (-1, sum(k[1] for k in known), merkle([k[2] for k in known]))], "bucket int, documents long, root binary").coalesce(1)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents rebuilt from the store; every digest is taken anew."""
    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    shared = recipes.select(F.explode("given").alias("g")).select("g.digest", "g.data")
    stored = {r["bucket"]: (r["documents"], bytes(r["root"])) for r in spark.read.schema("bucket int, documents long, root binary").parquet(f"{path}/manifest").collect()}
    again = {r["bucket"]: (r["documents"], bytes(r["root"])) for r in _manifest(spark, path).collect()}
    if stored != again:
        raise ValueError(f"the manifest of {path} and its recipes differ")
    ranges = max(1, max(stored) + 1)
    partial = recipes.filter("NOT whole")
    refs = partial.select("bucket", "start", F.explode(F.array_distinct(F.expr(EACH_DIGEST))).alias("digest"))
    brought = refs.join(shared, "digest").select("bucket", "start", F.lit(0).alias("kind"), "digest", "data")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("n_tokens", "long"), ("lengths", "binary"), ("digests", "binary"), ("leaf", "binary"))]
    rows = brought.select("*", *empty).unionByName(partial.select("bucket", "start", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("digest"), "data", "doc_id", "n_tokens", "lengths", "digests", "leaf"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_start, held = None, {}
        for b in batches:
            done = []
            for start, kind, key, data, doc_id, n, lengths, digests, leaf in zip(*[b.column(i).to_pylist() for i in range(9)], strict=True):
                if kind == 0:
                    if at_start != start:
                        at_start, held = start, {}
                    held[key] = data
                    continue
                borrowed, whole, at, parts_ = held if at_start == start else None, [], 0, np.frombuffer(lengths, "<i4").tolist()
                for k, length in enumerate(parts_):
                    name = digests[DIGEST * k : DIGEST * (k + 1)]
                    chunk = borrowed.get(name) if borrowed else None
                    if chunk is None:
                        chunk = data[at : at + 2 * length]
                        at += 2 * length
                    if digest(chunk) != name or len(chunk) != 2 * length:
                        raise ValueError(f"a chunk of document {doc_id} is damaged")
                    whole.append(chunk)
                if at != len(data) or _leaf(doc_id, start, lengths, digests) != leaf or sum(parts_) != n:
                    raise ValueError(f"the recipe of document {doc_id} is damaged")
                ids = b"".join(whole) if borrowed else data
                done.append((doc_id, start, n, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    columns = ["start", "kind", "digest", "data", "doc_id", "n_tokens", "lengths", "digests", "leaf"]
    ordered = rows.select("bucket", *columns).repartitionById(ranges, "bucket").sortWithinPartitions("start", "kind").drop("bucket")
    alone = recipes.filter("whole").withColumn("kind", F.lit(1)).withColumn("digest", F.lit(None).cast("binary")).select(*columns)
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return alone.mapInArrow(rebuild, out).unionByName(ordered.mapInArrow(rebuild, out))


def through_store(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the store and read it back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "ids")
    write_store(docs, vocabulary, path, end_id)
    return read_store(spark, path)
