"""Exact token counts of whole texts, huge ones by overlap resynchronisation.

Texts of at most ``chunk_chars`` code points are encoded whole. A longer one is cut into chunks
that overlap, each chunk is encoded with offsets, and two neighbours are spliced where both have a
token boundary that is proven stable: the code point before it is not white space, the one at it
is an ASCII space, and the one after it is not white space. No pre-token, special token or merge
can span such a place, and what follows it doesn't depend on what precedes it. As a check on the
proof the two encodings must also agree on every token between two such places of the overlap.
Where the overlap has no such pair of places, or they disagree, the overlap is doubled, in the end
up to the rest of the text.

Defined results: a null text counts as empty (0 tokens); equal rows are counted each; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm._shared import doc_texts

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def stable_places(text: str, lo: int, hi: int) -> list[int]:
    """Places in ``lo..hi`` where a space stands between two code points that aren't white space."""
    found, at = [], text.find(" ", max(lo, 1), hi)
    while at >= 0:
        if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            found.append(at)
        at = text.find(" ", at + 1, hi)
    return found


def encode_huge(text: str, tok, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """The ids of ``text``, piece by piece; no more than two chunks are held at once."""
    start, frm, left = 0, 0, None  # the chunk begins at start; its ids count from code point frm on
    while True:
        end = min(len(text), start + chunk)
        here = left or tok.encode(text[start:end], add_special_tokens=False)
        spans = here.offsets
        if end == len(text):
            yield [i for i, (a, _) in zip(here.ids, spans, strict=True) if a + start >= frm]
            return
        width, cut = overlap, None
        while cut is None:
            begin = max(frm, end - width)
            if begin <= frm:  # the overlap has become the chunk: take a longer chunk instead
                break
            ahead = tok.encode(text[begin : min(len(text), begin + chunk)], add_special_tokens=False)
            cut = _splice(text, here, start, ahead, begin, end)
            width *= 2
        if cut is None:
            chunk, left = chunk * 2, None
            continue
        yield [i for i, (a, _) in zip(here.ids, spans, strict=True) if frm <= a + start < cut]
        start, frm, left = begin, cut, ahead


def _splice(text: str, one, one_at: int, two, two_at: int, end: int) -> int | None:
    """A place that is a stable boundary of both encodings, with another one after it up to which they agree."""
    firsts = [{}, {}]
    for seen, enc, at in zip(firsts, (one, two), (one_at, two_at), strict=True):
        for k, (a, _) in enumerate(enc.offsets):
            seen.setdefault(a + at, k)
    places = [p for p in stable_places(text, two_at + 1, end - 1) if p in firsts[0] and p in firsts[1]]
    if len(places) < 2:
        return None
    p, q = places[0], places[-1]
    same = one.ids[firsts[0][p] : firsts[0][q]] == two.ids[firsts[1][p] : firsts[1][q]]
    return places[len(places) // 2] if same else None


def count_tokens(texts: list[str], tok, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    whole = [t if len(t) <= chunk else "" for t in texts]
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    counts = [len(e) for e in encode(whole, add_special_tokens=False)]
    return [n if len(t) <= chunk else sum(map(len, encode_huge(t, tok, chunk, overlap))) for n, t in zip(counts, texts, strict=True)]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, batch: int = 256) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``; ``vocabulary`` is a file for the library tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                texts = b.column(1).to_pylist()
                counts = count_tokens(texts, tok, chunk, overlap)
                columns = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
