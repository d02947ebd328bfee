"""Minimax contiguous partition into shards, with DataFrame and SQL functions only.

Atomic groups are the rows of equal text; they are ordered by the XXH64 of the text (texts that
share one stay together). The smallest capacity with which a greedy walk over the ordered groups
needs no more than the wanted number of shards is found by binary search, and the walk's cuts are
the shards' bounds.

The walk never sees all groups. It runs over segments of the key space: 4096 at first, each with
its bytes and its smallest and largest key. A segment of one key is atomic. For the others the
walk gives, per cut, the span in which it can lie whatever the segments hold inside; only the
segments in those spans are split, 64-fold, by one small aggregation, until every segment that a
cut can touch is atomic. So the driver holds a bounded number of sums, and the result is exact.

Law: ``bytes``. A row's size is its text's UTF-8 bytes plus 16. Defined results: a null text counts
as empty; a group larger than the ideal capacity fills a shard of its own bound; shards may stay
empty at the end when there are fewer groups; very long texts count whole; rows that repeat an id or a
text each have a slot of their own, in the shard of their text; a null ``doc_id`` is placed like any other; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import cut, doc_texts, numbered

OVERHEAD = 16
FIRST_BITS = 12
STEP_BITS = 6
#: Rows that one slice of a shard is to be numbered in.
SLICE_ROWS = 20_000
LEAST_SLICES = 64


@dataclass(frozen=True)
class Segment:
    lo: int
    hi: int
    size: int
    bits: int  # leading bits of the key that its rows share

    @property
    def atomic(self) -> bool:
        return self.lo == self.hi


def walk(segments: list[Segment], capacity: int) -> list[int] | None:
    """Index of each greedy shard's first segment, segments taken whole; None if one exceeds the capacity."""
    starts, filled = [0], 0
    for i, s in enumerate(segments):
        if s.size > capacity:
            return None
        if filled + s.size > capacity:
            starts.append(i)
            filled = 0
        filled += s.size
    return starts


def least_capacity(sizes: list[int], shards: int) -> int:
    """Smallest capacity for which a greedy walk over atomic ``sizes`` needs at most ``shards``."""
    lo, hi = max([-(-sum(sizes) // shards), *sizes]), sum(sizes)
    units = [Segment(i, i, x, 64) for i, x in enumerate(sizes)]
    while lo < hi:
        mid = (lo + hi) // 2
        if len(walk(units, mid)) <= shards:
            hi = mid
        else:
            lo = mid + 1
    return hi


def _reach(segments: list[Segment], ends: list[int], capacity: int, shards: int) -> list[tuple[int, int]]:
    """For each cut, the lowest and highest byte position that it can have, whatever segments hold inside."""
    from bisect import bisect_right

    spans, low, high = [], 0, 0
    for _ in range(shards):
        i = bisect_right(ends, low + capacity)
        low = max(low, ends[i - 1] if i else 0)  # unsplit segments only
        target = high + capacity
        i = bisect_right(ends, target)
        if i < len(segments) and segments[i].atomic:
            target = ends[i - 1] if i else 0
        high = min(max(target, high), ends[-1])
        spans.append((low, high))
    return spans


def _possible(segments: list[Segment], ends: list[int], capacity: int, shards: int) -> bool:
    return _reach(segments, ends, capacity, shards)[-1][1] >= ends[-1]


def _smallest(lo: int, hi: int, fits) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return hi


def _segments(rows: DataFrame, bits: int) -> list[Segment]:
    """At most one row for each prefix of so many bits that ``rows`` have."""
    prefix = F.shiftright("key", 64 - bits)
    found = rows.groupBy(prefix.alias("p")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("size")).collect()
    return [Segment(r["lo"], r["hi"], int(r["size"]), bits) for r in found]


def shard_bounds(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity and the first key of each shard but the first; ``rows`` have ``key`` and ``size``."""
    from itertools import accumulate

    segments = sorted(_segments(rows, FIRST_BITS), key=lambda s: s.lo)
    while segments:
        ends = list(accumulate(s.size for s in segments))
        total, largest = ends[-1], max([s.size for s in segments if s.atomic], default=0)
        floor = _smallest(max(largest, -(-total // shards)), total, lambda c: _possible(segments, ends, c, shards))
        roof = _smallest(floor, total, lambda c: (w := walk(segments, c)) is not None and len(w) <= shards)
        spans = [(a, b) for (a, _), (_, b) in zip(_reach(segments, ends, floor, shards), _reach(segments, ends, roof, shards), strict=True)]
        touched, k = [], 0
        for s, end in zip(segments, ends, strict=True):
            if not s.atomic and any(a < end and b > end - s.size for a, b in spans):
                touched.append(s)
        if not touched:
            return roof, [segments[i].lo for i in walk(segments, roof)[1:]]
        by_bits: dict[int, list[Segment]] = {}
        for s in touched:
            by_bits.setdefault(s.bits, []).append(s)
        gone, new = set(touched), []
        for bits, some in by_bits.items():
            new += _segments(rows.filter(F.shiftright("key", 64 - bits).isin([s.lo >> (64 - bits) for s in some])), min(64, bits + STEP_BITS))
        segments = sorted([s for s in segments if s not in gone] + new, key=lambda s: s.lo)
    return 0, []


def minimax_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: every row in a shard, slots from 0 without gaps."""
    text = doc_texts(docs)
    rows = cut(text.select("doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("key")))
    _, firsts = shard_bounds(rows.groupBy("key").agg(F.sum("size").alias("size")), shards)
    shard = sum([(F.col("key") >= F.lit(k)).cast("int") for k in firsts], F.lit(0))
    slices = max(LEAST_SLICES, -(-rows.count() // (shards * SLICE_ROWS)))
    placed = numbered(rows.withColumn("shard", shard), ["shard"], F.xxhash64("doc_id", "key"), slices, "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
