"""Document fingerprints: locality-sensitive quartile bucket digests.

Each window of four bytes gives the three byte triplets that contain its first byte; every triplet
is hashed into one of 128 buckets. A bucket's count is encoded by the quartile of all the bucket
counts that it lies in (two bits), the number of bytes by a logarithmic code. Two digests differ by
the sum of their quartile differences and of their length codes' difference; the score is bounded
by ``WORST``, which is what unrelated texts reach, and ``likeness`` maps it to 1 (equal) .. 0.

The edited text of a document is made of its own head and the head of the next document in
ascending ``doc_id``. Rows are dealt into ranges of ``doc_id``, each range also gets the first row
of the range after it, and a range is streamed in order: texts are shuffled once. There are as many
ranges as the bytes of text need, and range ``k`` is partition ``k``.

Defined results: a null text counts as empty; the empty text has the all-zero digest; equal texts
have equal digests; very long texts are digested whole, in windows; rows with a null ``doc_id`` come first; rows of one ``doc_id`` follow each
other in text order; a single row is its own next; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import doc_texts, range_count, range_cuts

BUCKETS = 128
WORST = 160
WINDOW = 1 << 20


def _mix(values: np.ndarray) -> np.ndarray:
    values = values * np.uint32(2654435761)
    return (values ^ (values >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(25)


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), WINDOW):
        b = np.frombuffer(data, np.uint8, min(len(data) - at, WINDOW + 3), at).astype(np.uint32)
        n = min(WINDOW, len(b))
        for salt, (i, j) in enumerate(((1, 2), (1, 3), (2, 3))):
            m = min(n, len(b) - j)
            if m > 0:
                counts += np.bincount(_mix(b[:m] | b[i : i + m] << np.uint32(8) | b[j : j + m] << np.uint32(16) | np.uint32(salt << 24)), minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """0 for an empty text, then four steps for each doubling."""
    return min(255, 1 + int(4 * math.log2(n))) if n else 0


def digest(text: str) -> str:
    """Two hex digits of length, then 64 of quartile codes."""
    data = text.encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    codes = sum((counts > ranked[BUCKETS * q // 4 - 1]).astype(np.uint8) for q in (1, 2, 3)).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return f"{length_code(len(data)):02x}{packed.astype(np.uint8).tobytes().hex()}"


def _codes(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], axis=1).ravel().astype(np.int16)


def difference(one: str, two: str) -> int:
    """0 for equal digests, at most ``WORST``."""
    apart = int(np.abs(_codes(one) - _codes(two)).sum()) + abs(int(one[:2], 16) - int(two[:2], 16))
    return min(WORST, apart)


def likeness(one: str, two: str) -> float:
    return 1.0 - difference(one, two) / WORST


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points, or all, of the next document's head."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, own: str, following: str, its: str) -> tuple:
    changed = edited(text, following)
    print_ = digest(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, print_, likeness(own, print_), likeness(own, its)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``range, copied, doc_id, text`` in order; a copied row is only the next of the row before it."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None  # range, doc_id, text, digest
    for b in batches:
        out = []
        for part, copied, doc_id, text in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            if copied and (last is None or last[0] != part):
                continue
            own = digest(text)
            if last is not None and last[0] == part:
                out.append(_row(*last[1:], text, own))
            last = None if copied else (part, doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(7)], names=names)


def _range_of(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, ids.fill_null(-(1 << 63)).to_numpy(), "right")


def _heads(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            rows = pa.table({"part": _range_of(ids, cuts), "doc_id": ids, "nulls": ids.is_null()}).group_by("part").aggregate([("doc_id", "min"), ("nulls", "max")])
            yield from rows.select(["part", "doc_id_min", "nulls_max"]).rename_columns(["part", "first", "nulls"]).combine_chunks().to_batches()

    return run


def _placed(cuts: np.ndarray, heads: np.ndarray, back: np.ndarray, nulls_first: bool):
    """Each row in its range, and the rows of a range's first id once more after the range before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, of = b.column(0), _range_of(b.column(0), cuts)
            head = ids.is_null().to_numpy(zero_copy_only=False)
            if nulls_first:
                head |= (ids.fill_null(0).to_numpy() == heads[of]) & ~head & (of != 0)
            else:
                head = ids.fill_null(0).to_numpy() == heads[of]
            for part, copied, some in ((of, 0, b), (back[of[head]], 1, b.filter(pa.array(head)))):
                columns = [pa.array(part, pa.int32()), pa.array(np.full(some.num_rows, copied), pa.int32()), some.column(0), some.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "copied", "doc_id", "text"])

    return run


def with_following(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``part, copied, doc_id, text``: each range of ``doc_id`` in order, and then the first row of the range after it.

    Range ``k`` is partition ``k``, and there are the more of them the more text there is. The driver
    holds a number for each range.
    """
    texts = doc_texts(docs)
    cuts = np.array(range_cuts(texts.filter("doc_id is not null"), "doc_id", parts or range_count(texts)), np.int64)
    found = texts.select("doc_id").mapInArrow(_heads(cuts), "part long, first long, nulls boolean")
    found = sorted(found.groupBy("part").agg(F.min("first"), F.max("nulls")).collect())  # one row a range
    heads, back = np.zeros(len(cuts) + 1, np.int64), np.full(len(cuts) + 1, -1, np.int64)
    for k, (part, first, _) in enumerate(found):
        heads[part], back[part] = first or 0, found[k - 1][0]
    nulls_first = bool(found) and found[0][2]
    placed = texts.mapInArrow(_placed(cuts, heads, back, nulls_first), "part int, copied int, doc_id long, text string")
    return placed.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "copied", "doc_id", "text")


def document_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each document: its digest, its edited text's, and how alike they and the next document's are."""
    return with_following(docs, parts).mapInArrow(_stream, COLUMNS)
