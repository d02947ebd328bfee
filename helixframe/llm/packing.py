"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

A document is its token ids and an end id. One longer than a sequence is cut into full pieces from
its end; its first piece may be shorter. Lengths are integers up to the capacity, so a packing is
decided on the number of pieces of each length, at most one number a length, however many pieces
there are:

1. Reduction. The longest remaining length and the set that provably dominates every other set it
   could share a sequence with are fixed together, for as many sequences as there are: the longest
   piece that fits beside it if that fills the sequence, or if no two pieces fit beside it, or
   nothing if nothing fits. A length for which no set dominates is set aside and the next ones are
   tried, until a whole pass settles nothing.
2. Best fit, longest first: each remaining length goes where the least room is left.

Both give patterns (lengths in order) and how many sequences follow each. Pieces are numbered
within their length, and a piece's number tells its pattern, sequence and offset.

Defined results: a null text counts as empty and is its end id alone; very long texts are encoded whole
and cut into pieces; equal rows and rows of one id are packed each;
an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import cut, doc_texts, numbered

CAPACITY = 1024
END_ID = 2
SLICE_ROWS = 20_000
LEAST_SLICES = 64

_encoders: dict[str, object] = {}


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def encoder(path: str):
    """An encoder with the ids of a byte-level BPE vocabulary file, special strings in a text included."""
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        symbols = _byte_symbols()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        plan = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        names = set(special)
        _encoders[path] = lambda text: plan.encode_to_numpy(text, allowed_special=names)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, cut where it is longer than a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                out += [(doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, ...], int]


def reduce_dominated(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that some optimal packing has; ``counts`` is left with what no rule settles."""
    fixed: list[Pattern] = []
    settled = True
    while settled:  # a length without a dominating set is set aside; what is settled after it may give it one
        settled = False
        for long in sorted((x for x, n in counts.items() if n), reverse=True):
            while counts[long]:
                counts[long] -= 1  # one is taken out, so that it may pair with its own kind
                here = sorted(x for x, n in counts.items() if n)
                counts[long] += 1
                room = capacity - long
                k = bisect_left(here, room + 1) - 1
                beside = here[k] if k >= 0 else 0
                least = here[0] if here else 0
                alone = counts.get(least, 0) - (least == long) <= 1
                two = (least + here[1] if len(here) > 1 else capacity + 1) if alone else 2 * least
                if not beside:  # nothing fits beside it
                    fixed.append(((long,), counts[long]))
                    counts[long] = 0
                elif beside == room or two > room:  # one fills it, or only one fits: the longest dominates
                    n = counts[long] // 2 if beside == long else min(counts[long], counts[beside])
                    if beside != room and beside == least and long != beside:
                        n = min(n, max(1, counts[beside] - 1))  # the two least are tested again once there is only one of them
                    fixed.append(((long, beside), n))
                    counts[long] -= n
                    counts[beside] -= n
                else:
                    break
                settled = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Longest first, each where the least room is left; sequences that are alike are handled as one."""
    open_: dict[int, list[list]] = {}  # room left -> [pattern, how many]
    rooms: list[int] = []
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        todo = counts[length]

        def put(pattern: tuple[int, ...], n: int) -> None:
            room = capacity - sum(pattern)
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([pattern, n])

        while todo:
            i = bisect_left(rooms, length)
            if i == len(rooms):  # new sequences, filled with as many of this length as they hold
                each = capacity // length
                if todo >= each:
                    put((length,) * each, todo // each)
                if todo % each:
                    put((length,) * (todo % each), 1)
                break
            room = rooms[i]
            each = room // length
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            full = min(n, todo // each)
            if full:
                put(pattern + (length,) * each, full)
                todo -= full * each
                n -= full
            if n and 0 < todo < each:
                put(pattern + (length,) * todo, 1)
                todo, n = 0, n - 1
            if n:
                put(pattern, n)
    return [(tuple(p), n) for same in open_.values() for p, n in same]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns and how many sequences follow each, for so many pieces of each length."""
    left = {x: n for x, n in counts.items() if n}
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def _places(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Runs of piece numbers of one length that lie at one offset of consecutive sequences: key, sequence, offset."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length << 44 | seen.get(length, 0), sequence, offset))
            seen[length] = seen.get(length, 0) + n
            offset += length
        sequence += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: a row for each piece."""
    made = cut(pieces(docs, vocabulary, capacity, end_id))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one a length
    keys, sequences, offsets = _places(pack_counts(counts, capacity))
    slices = max(LEAST_SLICES, -(-max(counts.values(), default=0) // SLICE_ROWS))
    ranked = numbered(made, ["length"], F.xxhash64("doc_id", "piece"), slices, "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(3).to_numpy() << 44 | b.column(5).to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            found = [pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *found], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    named = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return named.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
