"""SimHash near-duplicates by exact similarity of word shingles.

One 64-bit fingerprint can't tell a similarity of 0.8 (about 10 bits apart) by blocks, so this
stage has wide fingerprints of ``WIDE`` bits and other shards: texts meet in the shards of ``BANDS``
keys, each made of ``ROWS`` minima of their shingles' hashes (a pair of similarity 0.8 shares none with a
chance of 3e-6). In a shard the fingerprints are BK-trees, whose edges carry the integer Hamming
distance to the parent; a search follows only the edges within ``RADIUS`` bits, which a pair of
similarity 0.8 exceeds with a chance of 0.002 and a pair of 0.85 with less than 1e-5. What a search finds
is linked only if its exact Jaccard similarity is at least ``least``.

Most of a large group of copies is connected before trees are searched: each text is held against
one member of each of its shards, another one in each, by a search of the tree of these members. Trees are then searched only from the texts
that are not in the shard's largest component, and only for texts of other components. No row is made
for a pair that a search finds: of each shard come the texts that have a partner there, and these are
verified together, in tasks of bounded size, which give no more links than connect what is similar. A
partner is one within the radius that may be similar by the parities of its shingles: sets differ in at
least as many shingles as their ``odd`` bits do, so that no similar pair is lost by them. A pair counts in
the first shard only that it shares. Pairs of the first step, at most ``BANDS`` a text, are verified in
blocks of texts of bounded size that share partners, so that no text's shingles travel once for each pair.

What connects sets (``set_components``) serves any banded sketch; ``minhash`` calls it with another one
and without fingerprints.

Defined results: null and empty texts are alike; texts with fewer words than a shingle are one
shingle; A-Z is lower-cased, words are split at ASCII white space; texts of equal sets of shingles are
one node; texts and sets are told apart by digests of 128 bits. Very long texts are taken whole. Of a component the row
with the smallest ``doc_id`` stays (of rows that repeat it with the same text, one), one without an id
only where none has one; an empty table stays empty; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import HOT_SHARE, cut, doc_texts, join_counted
from helixframe.llm.simhash import SEED, BKTree, components

BANDS, ROWS = 24, 4
#: Bits of a fingerprint, and bits that a link may differ in.
WIDE, RADIUS = 512, 101
TREE = 1024
#: Texts that a worker has in hand at once.
AT_ONCE = 256
#: Cells whose parities are held against each other.
ODD = 2048
#: Texts of one block, which are verified against the members that they share.
BLOCKED = 64
#: Shingles that are mixed at once.
BLOCK = 4096
#: Bytes of shingle sets that are verified against each other at once, on each side.
SIDE = 8 << 20
_random = np.random.default_rng(11)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
ADDED = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
WIDENED = _random.integers(0, 1 << 63, WIDE // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64))


def _mixed(hashes: np.ndarray, factors: np.ndarray, added: np.ndarray | int) -> np.ndarray:
    x = hashes[:, None] * factors + added
    return x ^ x >> np.uint64(32)


def sketch(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """A signed 64-bit key for each band, and the wide fingerprint."""
    least, votes = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64), np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), BLOCK):
        some = hashes[at : at + BLOCK]
        least = np.minimum(least, _mixed(some, FACTORS, ADDED).min(axis=0))
        bits = _mixed(_mixed(some, WIDENED, 0).reshape(-1), np.array([0xD6E8FEB86659FD93], np.uint64), 0)
        votes += np.unpackbits(bits.reshape(len(some), -1).astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]
    return keys, np.packbits(votes * 2 > len(hashes)).tobytes()


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each of ``ODD`` cells: whether the number of hashes in it is odd. Sets differ in as many hashes at least as their bits."""
    cells = _mixed(hashes, np.array([0x9E3779B97F4A7C15], np.uint64), 0).reshape(-1) >> np.uint64(65 - ODD.bit_length())
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=ODD) & 1).tobytes()


def _differing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(others ^ one).sum(axis=1, dtype=np.int64)


def _fits(differ: np.ndarray, one: int, others: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes that differ in ``differ`` hashes at least can be similar."""
    return np.maximum(differ, np.abs(others - one)) * (1 + least) <= (others + one) * (1 - least) + 1e-6


def similarities(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarities of sorted sets."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    both = np.bincount(np.repeat(np.arange(len(others)), sizes), weights=one[at] == every, minlength=len(others))
    return both / (len(one) + sizes - both)


def _node() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def twin(hashes: np.ndarray) -> bytes:
    """Which set this is: sets of the same digest are the same."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _joined(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``join_counted`` for a small written ``table`` that has few of the keys: hot keys, fewer than ``HOT_SHARE``, are named in a filter, so that no other row goes through their join."""
    hot = table.filter(F.col(count) * HOT_SHARE > total)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return rows.join(table, key)
    own = [c for c in table.columns if c != key]
    at_once = rows.filter(F.col(key).isin(keys)).join(F.broadcast(hot.withColumnRenamed(key, "_hot_key")), F.col(key) == F.col("_hot_key"))
    rest = rows.filter(~F.col(key).isin(keys)).join(table.filter(~F.col(key).isin(keys)), key)
    return at_once.select(*rows.columns, *own).unionByName(rest.select(*rows.columns, *own))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few texts, so that a worker holds no more of them decoded."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def _sketched(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = []
            for text in b.column(2):
                hashes = shingle_set(text.as_py(), shingle)
                made.append((twin(hashes), len(hashes), *sketch(hashes), parities(hashes)))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            columns = [b.column(0), b.column(1), *[pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "twin", "size", "keys", "fp", "odd"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t.as_py(), shingle).astype("<u8").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["vertex", "set"])

    return run


def _verifier(least: float, radius: int | None):
    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        known = {v: np.frombuffer(s, "<u8") for v, s in zip(sets["vertex"].to_pylist(), sets["set"].to_pylist(), strict=True)}
        out: list[tuple[int, int]] = []
        asked: dict[int, list[int]] = {}
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            asked.setdefault(a, []).append(b)
        if radius is not None:  # of a text's partners those that a search of their tree finds
            fps = dict(zip(sets["vertex"].to_pylist(), sets["fp"].to_pylist(), strict=True))
            hubs = sorted({b for partners in asked.values() for b in partners})
            for a, at in zip(list(asked), _found([fps[b] for b in hubs], [fps[a] for a in asked], radius), strict=True):
                near = {hubs[i] for i in at}
                asked[a] = [b for b in asked[a] if b in near]
        for a, partners in asked.items():
            mine = known[a]
            fit = [b for b in partners if min(len(mine), len(known[b])) >= least * max(len(mine), len(known[b]))]
            if fit:
                found = similarities(mine, [known[b] for b in fit])
                out += [(a, b) for b, s in zip(fit, found, strict=True) if s >= least]
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _parts(bytes_: Column, rows: Column | None = None, most: int = TREE) -> Column:
    """Into how many parts so many bytes and rows are dealt, so that none has many more than ``SIDE`` of the one and ``most`` of the other."""
    return F.greatest(F.lit(1), F.ceil(bytes_ / SIDE), *[] if rows is None else [F.ceil(rows / most)]).cast("int")


def _dealt(by: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(by), F.col(parts)).cast("int")


def similar(pairs: DataFrame, sets: DataFrame, homes: DataFrame, least: float, prints: DataFrame | None = None, radius: int | None = None) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that are at least so similar. ``homes``: ``vertex, block, size``; texts of a block share partners.

    With a ``radius`` a block's ``b`` are a BK-tree of their fingerprints (``prints``: ``vertex, fp``), and only what a search from ``a`` finds there is verified.
    """
    here = pairs.join(homes.select(F.col("vertex").alias("a"), "block"), "a").join(homes.select(F.col("vertex").alias("b"), "size"), "b")
    partners = here.select("block", "b", "size").distinct()
    chunks = partners.groupBy("block").agg(_parts(F.sum("size") * 8).alias("chunks"), F.count(F.lit(1)).alias("n"))
    here = cut(here.join(chunks.select("block", "chunks"), "block").select("block", _dealt("b", "chunks").alias("chunk"), "a", "b"))
    needed = here.select("block", "chunk", F.col("a").alias("vertex")).unionByName(here.select("block", "chunk", F.col("b").alias("vertex"))).distinct()
    if radius is not None:
        needed = needed.join(prints.select("vertex", "fp"), "vertex")
    loaded = needed.join(sets, "vertex")
    pairs_of = here.toDF("pairs_block", "pairs_chunk", "a", "b")
    return loaded.groupBy("block", "chunk").cogroup(pairs_of.groupBy("pairs_block", "pairs_chunk")).applyInArrow(_verifier(least, radius), "a long, b long")


def _found(members: list[bytes], asking: list[bytes], radius: int) -> Iterator[list[int]]:
    """For each fingerprint of ``asking`` the places in ``members`` within ``radius``."""
    by_value: dict[int, list[int]] = {}
    for i, fp in enumerate(members):
        by_value.setdefault(int.from_bytes(fp, "big"), []).append(i)
    tree = BKTree(list(by_value))
    for fp in asking:
        yield [i for at in tree.search(int.from_bytes(fp, "big"), radius) for i in by_value[tree.values[at]]]


def _met(members: DataFrame, tree_size: int) -> DataFrame:
    """``key, members, asking``: each tree of a shard with each part of the texts that search it; ``members`` have ``key, vertex, fp, root`` and what else is to travel."""
    counts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(counts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root"))["root"].alias("main")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    dealt = join_counted(members, sizes, "key", "n", total)
    parts = F.ceil(F.col("n") / tree_size).cast("int")
    dealt = dealt.withColumn("tree", F.pmod(F.xxhash64("vertex"), parts).cast("int")).withColumn("m", F.struct(*[c for c in members.columns if c != "key"]))
    trees = dealt.groupBy("key", "tree").agg(F.collect_list("m").alias("members"))
    asking = dealt.filter("root != main").groupBy("key", F.col("tree").alias("part")).agg(F.collect_list("m").alias("asking"))
    return trees.join(asking, "key").repartition(F.col("key"), F.col("tree"), F.col("part")).select("key", "members", "asking")


def _promising(radius: int | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int], tuple[int, int, bytes]] = {}
            for at, key in enumerate(batch.column("key").to_pylist()):
                sides = []
                for side in ("members", "asking"):
                    structs = batch.column(side)[at].values
                    of = dict(zip([f.name for f in structs.type], structs.flatten(), strict=True))
                    fps, odd = of["fp"].to_pylist() if radius is not None else range(len(structs)), np.frombuffer(b"".join(of["odd"].to_pylist()), np.uint64).reshape(len(structs), -1)
                    keys = of["keys"].flatten().to_numpy().reshape(len(structs), -1)
                    sides.append((of["vertex"].to_numpy(), of["root"].to_numpy(), of["size"].to_numpy(), fps, odd, keys))
                (vertex, root, size, fps, odd, keys), asking = sides
                every = np.arange(len(vertex))
                searched = _found(fps, asking[3], radius) if radius is not None else (every for _ in asking[3])
                for (v, r, n, fp, bits, shards), found in zip(zip(*asking, strict=True), searched, strict=True):
                    near = np.array(found, np.int64)
                    near = near[root[near] != r]
                    near = near[_fits(np.zeros(len(near), np.int64), n, size[near], least)]
                    near = near[_fits(_differing(bits, odd[near]), n, size[near], least)]
                    near = near[shards[(keys[near] == shards).argmax(axis=1)] == key]
                    for i in near:
                        out[key, int(vertex[i])] = int(root[i]), int(size[i]), fps[i]
                    if len(near):
                        out[key, int(v)] = int(r), int(n), fp
            columns = [[k for k, _ in out], [v for _, v in out], *[[x[i] for x in out.values()] for i in range(2 if radius is None else 3)]]
            types = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=["key", "vertex", "root", "size", "fp"][: len(columns)])

    return run


def promising(members: DataFrame, least: float, radius: int | None = RADIUS, tree_size: int = TREE) -> DataFrame:
    """``key, vertex, root, size, fp``: the ``members`` (with ``size, odd, keys`` too) that have a partner of another component in the shard, once a shard.

    Without a ``radius`` there are no trees and no ``fp``: partners are told by sizes and parities alone.
    """
    out = "key long, vertex long, root long, size long" + ("" if radius is None else ", fp binary")
    return _met(members, tree_size).mapInArrow(_promising(radius, least), out).distinct()


def _linker(radius: int | None, least: float):
    def run(rows: pa.Table) -> pa.Table:
        asks, vertex, size = (rows[c].to_numpy() for c in ("asks", "vertex", "size"))
        component = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(s, "<u8") for s in rows["set"].to_pylist()]
        fps = None if radius is None else np.frombuffer(b"".join(rows["fp"].to_pylist()), np.uint64).reshape(len(sets), -1)
        odd = np.frombuffer(b"".join(map(parities, sets)), np.uint64).reshape(len(sets), -1)
        held, out = np.flatnonzero(~asks), []
        for q in np.flatnonzero(asks):
            near = held[component[held] != component[q]]
            if radius is not None:
                near = near[_differing(fps[q], fps[near]) <= radius]
            differ = _differing(odd[q], odd[near])
            fit = _fits(differ, size[q], size[near], least)
            near = near[fit][np.argsort(differ[fit], kind="stable")]
            at_once = 1
            while len(near):
                some, near = near[:at_once], near[at_once:]
                for m in some[similarities(sets[q], [sets[i] for i in some]) >= least]:
                    if component[m] != component[q]:
                        out.append((int(vertex[q]), int(vertex[m])))
                        component[component == component[m]] = component[q]
                near = near[component[near] != component[q]]
                at_once *= 2
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def linked(found: DataFrame, sets: DataFrame, least: float, radius: int | None = RADIUS, tree_size: int = TREE) -> DataFrame:
    """Similar pairs ``a, b`` that connect the components of ``promising`` texts in their shards; a task gives less links than it has components."""
    counts = found.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sizes = counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("all"), F.max(F.struct("n", "root"))["root"].alias("main"))
    parts = F.greatest(_parts(F.col("all") * 8), F.ceil(F.col("n") / tree_size).cast("int"))
    sizes = sizes.select("key", "n", "main", parts.alias("parts"))
    placed = join_counted(found, sizes, "key", "n", found.count()).withColumn("own", _dealt("vertex", "parts"))
    every, rest = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), [c for c in found.columns if c != "key"]
    members = placed.select("key", F.col("own").alias("tree"), every.alias("part"), F.lit(False).alias("asks"), *rest)
    asking = placed.filter("root != main").select("key", every.alias("tree"), F.col("own").alias("part"), F.lit(True).alias("asks"), *rest)
    loaded = members.unionByName(asking).join(sets, "vertex")
    return loaded.groupBy("key", "tree", "part").applyInArrow(_linker(radius, least), "a long, b long")


def rooted(rows: DataFrame, found: DataFrame, vertex: str, root: str) -> DataFrame:
    """``rows`` with the root of their ``vertex``: itself where nothing was ``found``."""
    return rows.join(found.select(F.col("node").alias(vertex), F.col("root").alias(root)), vertex, "left").withColumn(root, F.coalesce(root, vertex))


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id, node, text``: ``node`` tells which text it is."""
    return doc_texts(docs).select("doc_id", F.unhex(F.md5("text")).alias("node"), "text")


def one_each(sketches: DataFrame) -> DataFrame:
    """A row for each different set (``twin``) with a ``vertex`` number of its own; ``of`` names one of its rows, the one with the least id, of ``rows``."""
    same = [c for c in sketches.columns if c not in ("doc_id", "node", "twin")]
    own = [F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "node")).alias("of")]
    return cut(sketches.groupBy("twin").agg(*own, *[F.first(c).alias(c) for c in same])).withColumn("vertex", F.monotonically_increasing_id())


def sets_of(prints: DataFrame, texts: DataFrame, vertices: DataFrame, shingle: int) -> DataFrame:
    """``vertex, set``; of all rows that have a set only the one that names it moves."""
    one = prints.join(vertices, "vertex", "left_semi").select("vertex", F.col("of.doc_id").alias("with_id"), F.col("of.node").alias("with_node"))
    asked = texts.join(one, (F.col("node") == F.col("with_node")) & F.col("doc_id").eqNullSafe(F.col("with_id")))
    return asked.dropDuplicates(["vertex"]).select("vertex", "text").mapInArrow(_sets(shingle), "vertex long, set binary")


def set_components(prints: DataFrame, load: Callable[[DataFrame], DataFrame], least: float, radius: int | None = RADIUS) -> DataFrame:
    """``node, root``: components of the sets of ``prints`` (``vertex, size, keys, odd`` and, with a ``radius``, ``fp``) that share a key and are similar.

    ``load`` gives ``vertex, set`` of the vertices that it is asked for.
    """
    keyed = prints.select("vertex", "size", F.explode(F.array_distinct("keys")).alias("key"))
    # another member of each shard is its hub: the least one under a mask of the shard's own
    mask = F.xxhash64("key")
    buckets = keyed.groupBy("key").agg(F.min(F.col("vertex").bitwiseXOR(mask)).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = cut(buckets.select("key", F.col("least").bitwiseXOR(mask).alias("hub"), "n"))
    members = cut(_joined(keyed, buckets, "key", "n", prints.agg(F.sum(F.size("keys"))).first()[0] or 0))
    alike = cut(members.groupBy("vertex").agg(F.max_by("key", "n").alias("home"), F.max("size").alias("size")))
    spread = alike.groupBy("home").agg(_parts(F.sum("size") * 8, F.count(F.lit(1)), BLOCKED).alias("parts"), F.count(F.lit(1)).alias("count"))
    homes = join_counted(alike, spread, "home", "count", alike.count())
    homes = cut(homes.select("vertex", "size", F.xxhash64("home", F.pmod(F.xxhash64("vertex"), F.col("parts"))).alias("block")))
    sets = cut(load(homes.select("vertex")))

    star = members.filter("vertex != hub").select(F.col("vertex").alias("a"), F.col("hub").alias("b")).distinct()
    links = cut(similar(star, sets, homes, least, prints, radius))
    placed = rooted(members.select("key", "vertex"), components(links), "vertex", "root")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo != hi").select("key", "n")
    own = prints.select("vertex", "size", "odd", "keys", *["fp"] * (radius is not None))
    rest = cut(join_counted(placed, mixed, "key", "n", members.count()).select("key", "vertex", "root").join(own, "vertex"))
    links = links.unionByName(linked(cut(promising(rest, least, radius)), sets, least, radius))
    return components(links)


def classes(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``node, root``: every text's digest with its component's number."""
    texts = texts_of(docs)
    sketches = cut(texts.mapInArrow(_sketched(shingle), "doc_id long, node binary, twin binary, size long, keys array<long>, fp binary, odd binary"))
    prints = one_each(sketches)
    found = set_components(prints, lambda some: sets_of(prints, texts, some, shingle), least)
    placed = rooted(prints.select("twin", "vertex"), found, "vertex", "root")
    return sketches.select("node", "twin").distinct().join(placed, "twin").select("node", "root")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Of each component of similar texts one row of ``docs``, with all its columns."""
    rows = docs.select(_node().alias("_node"), F.col("doc_id").cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    nodes = rows.groupBy("_node").agg(F.min("_id").alias("_first"))
    placed = nodes.join(classes(docs, shingle, least).select(F.col("node").alias("_node"), "root"), "_node")
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("_first").isNull().alias("none"), "_first", "_node")).alias("k")).select(F.col("k._node").alias("_node"), F.col("k._first").alias("_first"))
    found = rows.join(kept, "_node").filter(F.col("_id").eqNullSafe(F.col("_first")))
    return found.dropDuplicates(["_node"]).select("_row.*")
