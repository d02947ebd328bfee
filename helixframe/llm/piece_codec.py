"""SentencePiece BPE encoding and decoding by a prefix table over merge types.

A piece is a merge type: the product of merges of adjacent symbols, best score first, leftmost on
ties. For every prefix of a text the last token of its encoding is unique. The table holds that
token for each prefix: an automaton finds the pieces that end at a place, longest first, and the
one that is compatible with the last token of the prefix before it is the answer (two tokens are
compatible if the merges, run over their two strings together, give these two tokens back). Ids
are then recovered backwards from the whole text's last token.

Only pieces that the merges can make of their own string take part. A code point that no piece
covers stands for its UTF-8 bytes' ids. No piece may hold a non-space before a space mark (checked
when the model is read), so a text falls into independent segments at such places; short segments'
ids are remembered, up to a bound.

Decoding is the library's ``decode``.

Defined results: a null text counts as empty, which has no ids and decodes to the empty text;
equal rows are encoded each; very long texts are encoded whole; an empty table gives an empty result; columns other than ``doc_id``
and ``text`` are ignored. Models with other normalisation than the identity are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm._shared import doc_texts

SPACE = "▁"
#: Segments remembered by a worker, and the longest one.
REMEMBERED = 1 << 18
LONGEST = 48

_loaded: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models with identity normalisation and a leading space")
        self.library = SentencePieceProcessor(model_file=path)
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        if any(p.type not in (1, 2, 3, 6) for p in model.pieces) or len(self.byte_ids) != 256:
            raise ValueError("only models with byte fallback and no user-defined pieces")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans a word boundary")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or self.merged(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.segment = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """The definition: merge the best-scoring adjacent pair, leftmost on ties, until none is a piece."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        todo: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(symbols) and (both := symbols[i] + symbols[after[i]]) in self.scores:
                heapq.heappush(todo, (-self.scores[both], i, both))

        for i in range(len(symbols)):
            offer(i)
        while todo:
            _, i, both = heapq.heappop(todo)
            j = after[i]
            if symbols[i] is None or j >= len(symbols) or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j], after[i] = both, None, after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [s for s in symbols if s is not None]

    def fits(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.compatible.get(pair)
        if known is None:
            known = self.merged(left + right) == [left, right]
            if len(self.compatible) < 2 * REMEMBERED:
                self.compatible[pair] = known
        return known

    def tokens(self, text: str) -> list[str]:
        """The encoding as strings: the table of last tokens forwards, then backwards through it."""
        last: list[str | None] = [None] * len(text)  # None: no piece, the code point itself
        compatible = self.compatible
        for end, piece in self.automaton.iter(text):
            if last[end] is None:
                start = end - len(piece)
                if start < 0:
                    last[end] = piece
                    continue
                left = last[start] or text[start]
                fits = compatible.get((left, piece))
                if self.fits(left, piece) if fits is None else fits:
                    last[end] = piece
        out, i = [], len(text) - 1
        while i >= 0:
            piece = last[i] or text[i]
            out.append(piece)
            i -= len(piece)
        out.reverse()
        return out

    def _ids(self, segment: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.tokens(segment):
            known = self.ids.get(piece)
            out += [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for segment in self.segment.findall(SPACE + text.replace(" ", SPACE)):
            ids = known.get(segment)
            if ids is None:
                ids = self._ids(segment)
                if len(segment) <= LONGEST and len(known) < REMEMBERED:
                    known[segment] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library's decode does it."""
        return self.library.decode(ids)


def codec(path: str) -> PieceCodec:
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, model: str, batch: int = 256) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, there and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                ids = [both.encode(t) for t in b.column(1).to_pylist()]
                sha = [hashlib.sha256(str(x)[1:-1].replace(" ", "").encode()).hexdigest() for x in ids]
                back = [hashlib.sha256(both.decode(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([both.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")
