"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's set of word shingles is thrown into ``COORDINATES`` bins in rounds: in round ``i`` every
member falls into one bin by that round's hash, and a bin keeps the least ``(round, hash)`` that fell
into it. A bin that was filled in one round can't change in a later one, so rounds end when all bins
are full: after one round for a large set, after about ``COORDINATES`` times the logarithm of it, divided
by the set's size, for a small one. After ``COORDINATES`` rounds the members go to the bins in turn, one
bin a round, so that every bin is filled by round ``2 * COORDINATES`` whatever the set. The bins of two
sets agree with a chance of their Jaccard similarity each, as if drawn without replacement (which gives
bounds on the deviation of their mean that independent minima have at best), and a sketch costs a
few passes over the set instead of one for each coordinate.

``ROWS`` bins make a band's key; sets meet where they share one of ``BANDS`` keys, which a pair of
similarity 0.8 fails to do with a chance of 3e-6. What meets is verified on the full sets and connected
by ``near_copies.set_components``: first each set against one member of each of its buckets, then only
what is in different components, found by sizes and parities that lose no similar pair, in parts of
bounded size. Equal sets are one vertex from the start, however many rows have them.

Defined results: A-Z is lower-cased, words are split at ASCII white space; a text with fewer words than a
shingle is one shingle; null, empty and blank texts have the empty set, link with nothing and are their
own component; very long texts are taken whole; rows that repeat an id or a text stay separate rows of one
component; a null ``doc_id`` names a component only if it has no other; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import cut, join_counted
from helixframe.llm.near_copies import one_each, parities, rooted, set_components, sets_of, shingle_set, slices, texts_of, twin
from helixframe.llm.simhash import SEED

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: Bits of a round's hash that order the members of a bin.
ORDER = 40
#: Members times rounds that are thrown at once.
THROWN = 1 << 16
#: The hash of no words.
NOTHING = xxhash.xxh64_intdigest(b"", SEED)
_random = np.random.default_rng(23)
ROUND = _random.integers(0, 1 << 63, 2 * COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def _thrown(hashes: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """The hash of each member in each round."""
    x = (hashes[None, :] ^ ROUND[rounds][:, None]) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def fast_sketch(hashes: np.ndarray) -> np.ndarray:
    """``COORDINATES`` values of a set of at least one member; of two sets each agrees with a chance of their similarity."""
    low = np.uint64((1 << ORDER) - 1)
    filled = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    done, open_ = 0, COORDINATES
    while open_ and done < COORDINATES:
        # as many rounds as are likely to fill all bins; later rounds never change a bin
        likely = 1 + int(COORDINATES * (np.log(COORDINATES) + 2)) // len(hashes)
        rounds = np.arange(done, min(COORDINATES, done + likely))
        for at in range(0, len(hashes), max(1, THROWN // len(rounds))):
            x = _thrown(hashes[at : at + max(1, THROWN // len(rounds))], rounds)
            bins = (x >> np.uint64(ORDER)) * np.uint64(COORDINATES) >> np.uint64(64 - ORDER)
            placed = np.sort((bins << np.uint64(ORDER + 10) | (rounds.astype(np.uint64) << np.uint64(ORDER))[:, None] | x & low).reshape(-1))
            which = (placed >> np.uint64(ORDER + 10)).astype(np.int64)
            first = np.flatnonzero(np.diff(which, prepend=-1))
            of = which[first]
            filled[of] = np.minimum(filled[of], placed[first] & np.uint64((1 << (ORDER + 10)) - 1))
        done += len(rounds)
        open_ = int((filled == np.iinfo(np.uint64).max).sum())
    for k in np.flatnonzero(filled == np.iinfo(np.uint64).max).tolist():
        filled[k] = np.uint64((COORDINATES + k) << ORDER) | (_thrown(hashes, np.array([COORDINATES + k])) & low).min()
    return filled


def band_keys(sketch: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band."""
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(sketch.astype("<u8").reshape(BANDS, ROWS))]


def _sketched(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = []
            for text in b.column(2):
                hashes = shingle_set(text.as_py(), shingle)
                if len(hashes) == 1 and hashes[0] == NOTHING:
                    hashes = hashes[:0]
                keys = band_keys(fast_sketch(hashes)) if len(hashes) else []
                made.append((twin(hashes), len(hashes), keys, parities(hashes)))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = [b.column(0), b.column(1), *[pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "twin", "size", "keys", "odd"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 4, least: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: documents connected by a similarity of ``least`` or more."""
    texts = texts_of(docs)
    sketches = cut(texts.mapInArrow(_sketched(shingle), "doc_id long, node binary, twin binary, size long, keys array<long>, odd binary"))
    prints = one_each(sketches.filter("size > 0"))
    found = set_components(prints, lambda some: sets_of(prints, texts, some, shingle), least, radius=None)
    placed = cut(rooted(prints.select("twin", "vertex", "rows", "first"), found, "vertex", "root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    total = placed.agg(F.count(F.lit(1)).alias("sets"), F.sum("rows").alias("rows")).first()
    called = join_counted(placed.select("twin", "root", "rows"), names, "root", "sets", total.sets).select("twin", "rows", "component_id")
    linked = join_counted(sketches.filter("size > 0").select("doc_id", "twin", "size"), called, "twin", "rows", total.rows or 0)
    alone = sketches.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    every = linked.select("doc_id", "size", "component_id").unionByName(alone)
    return every.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN links ON other = a)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""
