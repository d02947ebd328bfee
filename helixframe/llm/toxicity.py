"""Toxicity by a linear-chain conditional random field over the words of a whole text.

A word's evidence is the sum of hashed weights of the word itself, of its subwords (runs of
``LEAST`` to ``MOST`` letters, its two borders counted as letters, so beginnings and endings are
features of their own) and of the words before and after it; the two-state chain (clean, toxic) adds
weights for each transition. Inflections that the labels never showed share subwords with those that
they did.

Token labels: documents are labelled, words are not. A first labelling marks the words of toxic
documents that hold a feature whose share of toxic documents is beyond chance, by Chernoff's bound
over all features that are tried (``doubt`` false ones are expected in all). The field is trained on
it by the exact gradient that the forward-backward recursions give; then the words of toxic
documents are labelled anew by their marginals, given that at least one word of the document is
toxic, and the field is trained again, ``rounds`` times. A toxic document in which no word is
labelled teaches nothing, a clean one that all its words are clean.

A chain is the whole text, however long: it is computed in blocks of ``BLOCK`` words, whose transfer
matrices carry the messages over the blocks' borders exactly.

A document's score is a logistic function of three sums over its words' marginals (the logarithm of
the chance that none is toxic, the logarithm of the sum of their squares, their maximum), fitted on
documents that the field they are scored with has not seen (two halves, each scored by the other's
field) and weighted to the share of toxic labels among all training labels. Offending offsets are
the runs of words with a marginal of at least one half.

What is learned is bounded by parameters (rows and bytes of the sample, ``bits`` of the weights) and
broadcast. Labels, ``lang``, ``source`` and ``doc_id`` are never inputs of a score.

Defined results: a null text counts as empty and scores as a document without words; very long
texts are scored whole, in memory proportional to the text; a null ``doc_id`` is not held out; a
repeated ``doc_id`` is scored row by row, and learned from with the smallest of its labels; labels of
null value are not learned from; without both labels every score is the share of toxic ones (0.5 if
there are none); equal texts have equal scores; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are ignored, and passed through by ``keep_clean``.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import doc_texts
from helixframe.llm.quality import in_fold, labelled_sample
from helixframe.operators.seeds import code_points, window_hashes

WORDS = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")
#: Letters of the shortest and longest subwords, borders included.
LEAST, MOST = 4, 8
#: Weights: two to this power.
BITS = 20
#: Words of a block of a chain.
BLOCK = 32
#: Words that are scored at once; a longer text is by itself.
AT_ONCE = 1 << 16
START, END = "\x02", "\x03"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased words; their order is that of the matches in the text as it was."""
    return WORDS.findall(text.lower())


def _slots(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (hashes ^ np.uint64(salt)) * _SPREAD
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * _SPREAD) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Features:
    """Weight slots of distinct words: ``slots[starts[i]:starts[i + 1]]`` of word i, and those it has as a neighbour."""

    starts: np.ndarray
    slots: np.ndarray
    before: np.ndarray
    after: np.ndarray


def features_of(words: list[str], bits: int = BITS, shared: bool = False) -> Features:
    """Of distinct words; every word has one feature at least, itself. ``shared``: subwords that occur but once are left out, since no other word could learn from them."""
    whole = np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    letters = code_points("".join([START + w + END for w in words]))
    of = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(len(words), dtype=np.int32), _slots(whole, 1, bits))]
    for n in range(LEAST, MOST + 1):
        hashes = window_hashes(letters, n)
        within = np.flatnonzero(of[: len(hashes)] == of[n - 1 : n - 1 + len(hashes)])
        hashes, ids = hashes[within], of[within]
        if shared and len(within):
            ranked = np.sort(hashes)
            again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
            often = again[np.minimum(np.searchsorted(again, hashes), max(0, len(again) - 1))] == hashes if len(again) else np.zeros(len(hashes), bool)
            hashes, ids = hashes[often], ids[often]
        found.append((ids, _slots(hashes, 16 + n, bits)))
    # each size's features come in order of words: their places follow from how many a word has
    counts = [np.bincount(ids, minlength=len(words)) for ids, _ in found]
    starts = np.concatenate([[0], np.cumsum(sum(counts))]).astype(np.int64)
    out, filled = np.empty(int(starts[-1]), np.int32), starts[:-1].copy()
    for (ids, slots), n in zip(found, counts, strict=True):
        out[np.repeat(filled - (np.cumsum(n) - n), n) + np.arange(len(ids))] = slots
        filled += n
    return Features(starts, out, _slots(whole, 2, bits), _slots(whole, 3, bits))


def grid_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of chains of these lengths: the document of each block, and its number in the document."""
    blocks = -(-lengths // BLOCK)
    of = np.repeat(np.arange(len(lengths)), blocks)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)


def on_grid(values: np.ndarray, lengths: np.ndarray, fill: float = np.nan) -> np.ndarray:
    """Values of all documents' words, one after another, as rows of blocks."""
    blocks = -(-lengths // BLOCK)
    out = np.full(int(blocks.sum()) * BLOCK, fill)
    out[_places(lengths)] = values
    return out.reshape(-1, BLOCK)


def _places(lengths: np.ndarray) -> np.ndarray:
    blocks = -(-lengths // BLOCK)
    shift = (np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(lengths) - lengths)
    return np.arange(int(lengths.sum())) + np.repeat(shift, lengths)


def recursions(emission: np.ndarray, number: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, expected transitions (2, 2), and each block's share of the logarithm of the chance that all of its chain is clean.

    ``emission`` (blocks, places) is the score of toxic against clean, NaN after a chain's end;
    ``number`` is a block's number in its chain, whose blocks follow each other.
    """
    rows, places = emission.shape
    here = ~np.isnan(emission)
    factor = np.exp(np.clip(np.where(here, emission, 0.0), -30, 30))
    t, eye = np.exp(transition), np.eye(2)
    first = number == 0
    into, outof = np.ones((2, rows)), np.ones((2, rows))

    def step(i: int) -> np.ndarray:
        """Transitions into place i of every block (2, 2, blocks): none at a chain's start and after its end."""
        none = ~here[:, i] | (first if i == 0 else False)
        return np.where(none, eye[:, :, None], t[:, :, None])

    if rows and number.max() > 0:
        moved = np.broadcast_to(eye[:, :, None], (2, 2, rows)).copy()
        for i in range(places):
            s = step(i)
            moved = np.stack([moved[:, 0] * s[0, 0] + moved[:, 1] * s[1, 0], (moved[:, 0] * s[0, 1] + moved[:, 1] * s[1, 1]) * factor[:, i]], axis=1)
            moved /= moved.sum(axis=(0, 1))
        order = np.argsort(number, kind="stable")
        cuts = np.searchsorted(number[order], np.arange(number.max() + 2))
        turns = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for at in turns[1:]:
            v, m = into[:, at - 1], moved[:, :, at - 1]
            into[:, at] = v[0] * m[0] + v[1] * m[1]
            into[:, at] /= into[:, at].sum(axis=0)
        for at in reversed(turns[1:]):
            v, m = outof[:, at], moved[:, :, at]
            outof[:, at - 1] = m[:, 0] * v[0] + m[:, 1] * v[1]
            outof[:, at - 1] /= outof[:, at - 1].sum(axis=0)
    ahead = np.empty((places, 2, rows))
    at = into
    for i in range(places):
        s = step(i)
        at = np.stack([at[0] * s[0, 0] + at[1] * s[1, 0], (at[0] * s[0, 1] + at[1] * s[1, 1]) * factor[:, i]])
        at /= at.sum(axis=0)
        ahead[i] = at
    back = outof
    marginal, moves, clean = np.zeros((rows, places)), np.zeros((2, 2)), np.zeros(rows)
    for i in range(places - 1, -1, -1):
        both = ahead[i] * back
        marginal[:, i] = both[1] / both.sum(axis=0)
        real = here[:, i] & ~(first if i == 0 else np.zeros(rows, bool))
        after = np.stack([back[0], back[1] * factor[:, i]])
        joint = (ahead[i - 1] if i else into)[:, None, :] * t[:, :, None] * after[None]
        joint *= real / joint.sum(axis=(0, 1))
        moves += joint.sum(axis=2)
        stays = joint[0, 0] / np.maximum(joint[0].sum(axis=0), 1e-300)
        clean += np.where(real, np.log(np.maximum(stays, 1e-300)), 0.0)
        s = step(i)
        back = np.stack([s[0, 0] * after[0] + s[0, 1] * after[1], s[1, 0] * after[0] + s[1, 1] * after[1]])
        back /= back.sum(axis=0)
    marginal[~here] = 0.0
    clean += np.where(first & here[:, 0], np.log(np.maximum(1 - marginal[:, 0], 1e-300)), 0.0)
    return marginal, moves, clean


def document_features(marginals: np.ndarray, of: np.ndarray, clean: np.ndarray, docs: int) -> np.ndarray:
    """A row for each document: one, the (negative) logarithm of the chance of no toxic word, log of the sum of squares, maximum."""
    most = np.zeros(docs)
    np.maximum.at(most, of, marginals.max(axis=1, initial=0.0))
    none = np.log1p(np.maximum(0.0, -np.bincount(of, weights=clean, minlength=docs)))
    squares = np.log1p(np.bincount(of, weights=(marginals**2).sum(axis=1), minlength=docs))
    return np.column_stack([np.ones(docs), none, squares, most])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    scale: np.ndarray
    bits: int = BITS

    def word_weights(self, words: list[str]) -> np.ndarray:
        """As a row for each distinct word: its weight before, in, and after its place."""
        out = np.zeros((len(words), 3))
        for at in range(0, len(words), AT_ONCE):
            f = features_of(words[at : at + AT_ONCE], self.bits)
            out[at : at + AT_ONCE] = np.column_stack([self.weights[f.before], np.add.reduceat(self.weights[f.slots], f.starts[:-1]), self.weights[f.after]])
        return out

    def run(self, texts: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Marginals of each document's words, and its features."""
        lengths = np.array([len(x) for x in texts], np.int64)
        numbers: dict[str, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for x in texts for w in x], np.int64)
        emission = self.emission(self.word_weights(list(numbers)), ids, lengths)
        of, number = grid_of(lengths)
        marginal, _, clean = recursions(on_grid(emission, lengths), number, self.transition)
        flat = marginal.reshape(-1)[_places(lengths)]
        return np.split(flat, np.cumsum(lengths)[:-1]) if len(texts) else [], document_features(marginal, of, clean, len(texts))

    def emission(self, weights: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of the words ``ids`` of documents one after another; neighbours end at a document's borders."""
        score = weights[ids, 1] + self.bias
        if len(ids) > 1:
            inner = np.ones(len(ids), bool)  # not the first of its document
            starts = np.cumsum(lengths) - lengths
            inner[starts[lengths > 0]] = False
            score[1:] += np.where(inner[1:], weights[ids[:-1], 0], 0.0)
            score[:-1] += np.where(inner[1:], weights[ids[1:], 2], 0.0)
        return score

    def from_features(self, found: np.ndarray) -> list[float]:
        return (1.0 / (1.0 + np.exp(-np.clip(found @ self.scale, -30, 30)))).tolist()

    def score_all(self, texts: list[str]) -> list[float]:
        out, held, words = [], [], 0
        for t in texts:
            held.append(words_of(t))
            words += len(held[-1])
            if words >= AT_ONCE:
                out += self.from_features(self.run(held)[1])
                held, words = [], 0
        return out + self.from_features(self.run(held)[1])

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """``start, end, probability`` in code points of the runs of toxic words."""
        marginal = self.run([words_of(text)])[0][0]
        if not (marginal >= 0.5).any():
            return []
        out: list[tuple[int, int, float]] = []
        last = -2
        for i, m in enumerate(WORDS.finditer(text)):
            if marginal[i] >= 0.5:
                if last == i - 1:
                    out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(marginal[i])))
                else:
                    out.append((m.start(), m.end(), float(marginal[i])))
                last = i
        return out


def slot_counts(features: Features, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a document's words, and how often each occurs in it."""
    words, times = np.unique(ids, return_counts=True)
    at, n = _spread(features, words)
    slots, which = np.unique(features.slots[at], return_inverse=True)
    return slots, np.bincount(which, weights=np.repeat(times, n), minlength=len(slots))


def _spread(features: Features, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the slots of ``words`` are, and how many each has."""
    n = np.diff(features.starts)[words]
    return np.repeat(features.starts[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


def beyond_chance(features: Features, rows: list[tuple[np.ndarray, int]], doubt: float, odds: float, bits: int) -> np.ndarray:
    """How often a document must hold each weight slot to be marked by it: once, twice, or (0) it is no mark.

    A mark is ``odds`` times as frequent in toxic documents as in clean ones, and more of the
    documents that hold it are toxic than chance allows.
    """
    within = np.zeros((2, 2, 1 << bits), np.int32)  # once or twice, clean or toxic
    for ids, y in rows:
        slots, times = slot_counts(features, ids)
        within[0, y, slots] += 1
        within[1, y, slots[times > 1]] += 1
    bad = sum(y for _, y in rows)
    share, out = bad / len(rows), np.zeros(1 << bits, np.int8)
    tried = max(1, int((within.sum(axis=1) > 0).sum()))
    for k in (1, 0):
        clean, toxic = within[k]
        both = clean + toxic
        with np.errstate(divide="ignore", invalid="ignore"):
            sure = np.where(toxic > 0, toxic * np.log(toxic / both / share), 0.0) + np.where(clean > 0, clean * np.log(clean / both / (1 - share)), 0.0)
        often = (toxic + 0.5) / (bad + 1) >= odds * (clean + 0.5) / (len(rows) - bad + 1)
        out[(both > 0) & often & (toxic > share * both) & (sure >= np.log(tried / doubt))] = k + 1
    return out


class Field:
    """The field in training: distinct words' features once, AdaGrad over batches of whole documents."""

    def __init__(self, texts: list[tuple[list[str], int]], bits: int):
        numbers: dict[str, int] = {}
        self.rows = [(np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int32), y) for t, y in texts]
        self.features = features_of(list(numbers), bits, shared=True)
        self.bits = bits

    def first_labels(self, doubt: float, odds: float) -> list[np.ndarray]:
        least = beyond_chance(self.features, self.rows, doubt, odds, self.bits)
        out = []
        for ids, y in self.rows:
            found = np.zeros(len(ids), bool)
            if y and len(ids):
                slots, times = slot_counts(self.features, ids)
                held = slots[(least[slots] > 0) & (times >= least[slots])]
                words, which = np.unique(ids, return_inverse=True)
                at, n = _spread(self.features, words)
                found = np.maximum.reduceat(np.isin(self.features.slots[at], held), np.cumsum(n) - n)[which]
            out.append(found)
        return out

    def _gathered(self, chosen: list[int]) -> tuple:
        lengths = np.array([len(self.rows[d][0]) for d in chosen], np.int64)
        words, ids = np.unique(np.concatenate([self.rows[d][0] for d in chosen]), return_inverse=True)
        at, n = _spread(self.features, words)
        return lengths, words, ids, n, self.features.slots[at]

    def weights(self, model: Model, words: np.ndarray, n: np.ndarray, slots: np.ndarray) -> np.ndarray:
        f = self.features
        own = np.add.reduceat(model.weights[slots], np.cumsum(n) - n)
        return np.column_stack([model.weights[f.before[words]], own, model.weights[f.after[words]]])

    def train(self, labels: list[np.ndarray], epochs: int, rate: float, batch: int, least_steps: int, model: Model | None = None) -> Model:
        model = model or Model(np.zeros(1 << self.bits), -4.0, np.zeros((2, 2)), np.zeros(4), self.bits)
        use = [d for d, (ids, y) in enumerate(self.rows) if len(ids) and (not y or labels[d].any())]
        squares, tsquares, bsquare = np.full(1 << self.bits, 1.0, np.float32), np.full((2, 2), 1e-2), 1e-2
        mixer = np.random.default_rng(7)
        batch = max(8, min(batch, len(use) // 16))
        f = self.features
        for _ in range(max(epochs, -(-least_steps * batch // max(1, len(use))))):
            mixed = mixer.permutation(len(use))
            for at in range(0, len(mixed), batch):
                chosen = [use[k] for k in mixed[at : at + batch]]
                lengths, words, ids, n, slots = self._gathered(chosen)
                emission = model.emission(self.weights(model, words, n, slots), ids, lengths)
                y = np.concatenate([labels[d] for d in chosen]).astype(float)
                _, number = grid_of(lengths)
                marginal, moves, _ = recursions(on_grid(emission, lengths), number, model.transition)
                off = marginal.reshape(-1)[_places(lengths)] - y
                inner = np.ones(len(ids), bool)
                inner[np.cumsum(lengths) - lengths] = False
                was, now = y[:-1][inner[1:]].astype(int), y[1:][inner[1:]].astype(int)
                actual = np.bincount(2 * was + now, minlength=4).reshape(2, 2)
                own = np.bincount(ids, weights=off, minlength=len(words))
                before = np.bincount(ids[:-1], weights=np.where(inner[1:], off[1:], 0.0), minlength=len(words))
                after = np.bincount(ids[1:], weights=np.where(inner[1:], off[:-1], 0.0), minlength=len(words))
                where = np.concatenate([slots, f.before[words], f.after[words]])
                gradient = np.bincount(where, weights=np.concatenate([np.repeat(own, n), before, after]), minlength=1 << self.bits)
                touched = np.flatnonzero(gradient)
                gradient = gradient[touched]
                squares[touched] += gradient**2
                model.weights[touched] -= rate * gradient / np.sqrt(squares[touched])
                moved = (moves - actual) / len(chosen)
                tsquares += moved**2
                model.transition = model.transition - 0.1 * moved / np.sqrt(tsquares)
                slope = off.sum() / len(chosen)
                bsquare += slope**2
                model.bias -= 0.1 * slope / bsquare**0.5
        return model

    def apply(self, model: Model, which: list[int], at_once: int = 256):
        """Marginals and features of documents ``which``, and the chance that a document has no toxic word."""
        marginals, found = [], []
        for k in range(0, len(which), at_once):
            chosen = which[k : k + at_once]
            lengths, words, ids, n, slots = self._gathered(chosen)
            emission = model.emission(self.weights(model, words, n, slots), ids, lengths) if len(ids) else np.zeros(0)
            of, number = grid_of(lengths)
            marginal, _, clean = recursions(on_grid(emission, lengths), number, model.transition)
            marginals += np.split(marginal.reshape(-1)[_places(lengths)], np.cumsum(lengths)[:-1])
            found.append(document_features(marginal, of, clean, len(chosen)))
        return marginals, np.concatenate(found) if found else np.zeros((0, 4))

    def relabelled(self, model: Model) -> list[np.ndarray]:
        """Words of toxic documents that are likely toxic, given that one of them is."""
        bad = [d for d, (_, y) in enumerate(self.rows) if y]
        marginals, found = self.apply(model, bad)
        out = [np.zeros(len(ids), bool) for ids, _ in self.rows]
        for d, m, x in zip(bad, marginals, found, strict=True):
            some = -np.expm1(-np.expm1(x[1]))  # x[1] is log1p of the negative logarithm of the chance of none
            out[d] = m >= 0.5 * max(some, 1e-12)
        return out


def train(texts: list[tuple[list[str], int]], prior: float | None, doubt: float = 0.01, odds: float = 8.0, rounds: int = 1, bits: int = BITS, epochs: int = 2, rate: float = 0.5, batch: int = 64, least_steps: int = 80) -> Model:
    """``texts``: a document's words and its label; ``prior``: the share of toxic labels that scores are held against."""
    share = 0.5 if prior is None else min(max(prior, 1e-6), 1 - 1e-6)
    flat = Model(np.zeros(1 << bits, np.float32), -5.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]), bits)
    if len({y for _, y in texts}) < 2:
        return flat

    def fitted(some: list[tuple[list[str], int]]) -> Model | None:
        f = Field(some, bits)
        labels, model = f.first_labels(doubt, odds), None
        for k in range(rounds + 1):
            if not any(x.any() for x in labels):
                break
            model = f.train(labels, epochs, rate, batch, least_steps, model)
            if k < rounds:
                labels = f.relabelled(model)
        return model

    halves = [[x for i, x in enumerate(texts) if i % 2 == k] for k in (0, 1)]
    seen, truth = [], []
    for mine, others in (halves, halves[::-1]):
        made = fitted(mine) if len({y for _, y in mine}) == 2 else None
        if made is not None:
            seen.append(made.run([t for t, _ in others])[1])
            truth += [y for _, y in others]
    made = fitted(texts)
    if made is None:
        return flat
    model = made
    x, y = (np.concatenate(seen), np.array(truth, float)) if seen else (made.run([t for t, _ in texts])[1], np.array([y for _, y in texts], float))
    model.scale = _calibrated(x, y, share)
    model.weights = model.weights.astype(np.float32)
    return model


def _calibrated(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression on the document features by Newton steps, weighted to the share of toxic labels."""
    if y.min() == y.max():
        return np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, ridge = np.zeros(4), np.diag([1e-4, 0.5, 0.5, 0.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -4, 4)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, max_rows: int = 4000, max_bytes: int = 20_000) -> Model:
    """Train on a bounded sample of labelled rows, half of them toxic where there are as many.

    One task trains on the whole sample (at most ``max_rows`` texts of ``max_bytes``); the driver gets the model alone.
    """
    counted = labels.filter(F.col(label).isNotNull() & ~in_fold(F.col("doc_id"), folds, fold)).agg(F.avg(F.col(label).cast("double"))).first()[0]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((p, t, y) for b in batches for p, t, y in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True))
        same: dict[str, str] = {}
        rows = [([same.setdefault(w, w) for w in words_of(t)], y) for t, y in dict.fromkeys((t, y) for _, t, y in found)]
        del found
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows, counted))], pa.binary())], names=["model"])

    sample = labelled_sample(docs, labels, label, folds, fold, max_rows, max_bytes, per_class=True).select("place", "text", "label")
    made = sample.repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(made.model) if made else train([], counted)


def scores(docs: DataFrame, model: Model, folds: int = 5, fold: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = shared.value.score_all(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    texts = doc_texts(docs)
    return texts.select("doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxic_spans(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, spans``: offending offsets of every row, in code points, with their greatest marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("start", "end", "probability"), s, strict=True)) for s in shared.value.spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, spans array<struct<start: int, end: int, probability: double>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
                yield b.filter(pa.array([s < 0.5 for s in shared.value.score_all(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
