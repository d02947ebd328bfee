"""SimHash near-duplicate detection over broadcastable BK-tree shards.

A document's words become shingles, the shingles' XXH64 hashes vote on a 64-bit fingerprint, and
fingerprints at most ``radius`` bits apart are linked. Fingerprints are sharded by the pigeonhole
principle: cut into ``radius + 2`` blocks, two linked fingerprints agree in two blocks at least, so
they meet in the shard of those two blocks' values (26 bits of 64 at radius 3, so that shards stay
small however many fingerprints there are). A shard of at most ``tree_size`` fingerprints is one
BK-tree whose edges carry the integer Hamming distance to the parent; a search follows only the
edges within the radius. A larger shard is several trees, and each tree is also searched with the
members of its sister trees, and a tree is built but once for all sisters that travel with it. Trees give a spanning set of links, not all pairs, and connected
components are found by contraction within tasks, then by alternating star contraction between them.

Defined results: null and empty texts have fingerprint zero and link like any other; texts with
fewer words than a shingle count as one shingle; repeated shingles vote repeatedly; very long texts are
fingerprinted whole, in blocks; equal rows stay separate rows of one component; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored. A null ``doc_id`` never becomes a component's id unless its
component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import cut, doc_texts, join_counted

BITS = 64
SEED = 42
#: Hashes whose bits are spread out at once.
VOTES = 1 << 16
#: Links that one task contracts by itself.
CONTRACTED = 1 << 19


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the whole text; A-Z lower-cased, words split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))
    votes, hashed = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, len(grams), VOTES):
        digests = b"".join([hashed(g, SEED) for g in grams[at : at + VOTES]])
        votes += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(grams)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_signed(fingerprint(t, shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Fingerprints by Hamming distance: a child hangs on the edge numbered with its distance to the parent."""

    def __init__(self, values: list[int] = ()):
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []
        for v in values:
            self.add(v)

    def add(self, value: int) -> int:
        """The place of ``value``, old if it was there."""
        if not self.values:
            self.values.append(value)
            self.edges.append({})
            return 0
        at = 0
        while distance := (self.values[at] ^ value).bit_count():
            below = self.edges[at].get(distance)
            if below is None:
                self.edges[at][distance] = below = len(self.values)
                self.values.append(value)
                self.edges.append({})
                return below
            at = below
        return at

    def search(self, value: int, radius: int) -> Iterator[int]:
        """Places within ``radius`` of ``value``."""
        todo = [0] if self.values else []
        values, edges = self.values, self.edges
        while todo:
            at = todo.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            if below := edges[at]:
                if len(below) <= 2 * radius + 1:
                    todo += [place for k, place in below.items() if -radius <= k - distance <= radius]
                else:
                    todo += [below[k] for k in range(distance - radius, distance + radius + 1) if k in below]


def shard_links(members: list[int], others: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever the radius connects: among ``members``, or from ``others`` to ``members``.

    At most one link per value comes back, to the smallest value that it reaches here.
    """
    mask = (1 << BITS) - 1
    members = [v & mask for v in members]
    values = members if others is None else members + [v & mask for v in others]
    root = list(range(len(values)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree = BKTree()
    if others is not None:
        for v in members:
            tree.add(v)
    for i in range(len(values) if others is None else 0):
        for near in tree.search(values[i], radius):
            if (a := top(i)) != (b := top(near)):
                root[max(a, b)] = min(a, b)
        tree.add(values[i])
    if others is not None:
        for i in range(len(members), len(values)):
            for near in tree.search(values[i], radius):
                if (a := top(i)) != (b := top(near)):
                    root[max(a, b)] = min(a, b)
    return [(_signed(values[i]), _signed(values[t])) for i in range(len(values)) if (t := top(i)) != i]


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for m, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in shard_links(m, o, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def near_links(distinct: DataFrame, radius: int = 3, tree_size: int = 1024) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints of column ``fp``, enough to connect what the radius connects."""
    blocks = radius + 2
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    value = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    widths = [hi - lo for lo, hi in zip(bounds, bounds[1:], strict=False)]
    pairs = list(combinations(range(blocks), 2))
    keys = F.array(*[(F.shiftleft(value[i], widths[j]).bitwiseOR(value[j])) * len(pairs) + k for k, (i, j) in enumerate(pairs)])
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree_size).select("key", F.ceil(F.col("n") / tree_size).cast("int").alias("trees"))
    dealt = keyed.join(sizes, "key", "left").withColumn("trees", F.coalesce("trees", F.lit(1))).withColumn("tree", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    rows = distinct.count() * len(pairs)
    shards = cut(dealt.groupBy("key", "trees", "tree").agg(F.collect_list("fp").alias("fps")).filter((F.size("fps") > 1) | (F.col("trees") > 1)), rows)
    inner = shards.filter(F.size("fps") > 1).select("fps", F.lit(None).cast("array<long>").alias("others"))
    hot = shards.filter("trees > 1")
    sisters = hot.select("key", "tree", "fps").join(hot.select("key", F.col("tree").alias("other"), F.col("fps").alias("others")), "key").filter("tree < other")
    across = sisters.repartition(F.col("key"), F.col("tree"), F.col("other")).select("fps", "others")
    return inner.unionByName(across).mapInArrow(_linked(radius), "a long, b long")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of this task's links with the smallest node that they reach from it."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (above := root.setdefault(x, x)) != x:
            root[x] = x = root[above]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (a := top(u)) != (b := top(v)):
                root[max(a, b)] = min(a, b)
    found = [(x, t) for x in list(root) if (t := top(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])


def components(links: DataFrame, rounds: int = 60, at_once: int = CONTRACTED) -> DataFrame:
    """``node``, ``root``: each linked node with the smallest node that it reaches, itself included.

    Tasks contract ``at_once`` links each to stars; what more than one task gives is joined by
    alternating large-star and small-star contraction, until a round changes nothing. Links are only
    counted and hashed by the driver, whose plans are few as long as one task does.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"))
    size, state = edges.count(), None
    tasks = max(1, -(-size // at_once))
    # deal out anew only what is many tasks' work: coalesced partitions keep no bound on their rows
    edges = cut((edges.coalesce(1) if tasks == 1 else edges.repartition(tasks)).mapInArrow(_contracted, "u long, v long"))
    for _ in range(rounds if tasks > 1 else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u")
        edges = cut(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), size)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    else:
        if tasks > 1:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, tree_size: int = 1024) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest ``doc_id`` reachable)."""
    marked = cut(fingerprints(docs, shingle))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    found = components(near_links(nodes.select("fp"), radius, tree_size)).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    # a component's fingerprints are counted, so that a hot one's rows aren't dealt by its name
    sized = names.join(placed.groupBy("root").agg(F.count(F.lit(1)).alias("fps")), "root")
    total = nodes.agg(F.count(F.lit(1)).alias("fps"), F.sum("rows").alias("rows")).first()
    named = join_counted(placed.select("fp", "root", "rows"), sized, "root", "fps", total.fps).select("fp", "rows", "component_id")
    return join_counted(marked, named, "fp", "rows", total.rows or 0).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
