"""Importance resampling towards a target: documents whose hashed word n-grams are likely there.

Features are all runs of 1 to ``n`` consecutive words, hashed into buckets. The gain of a bucket is the
scaled logarithm of how much more frequent it is in the target than in the documents; a document's
weight is the mean gain of its features, and adding Gumbel noise that depends on its id alone turns the
highest scores into a sample without replacement.

A text of over ``CHUNK`` bytes is cut at word boundaries into chunks that are dealt over all tasks, so that
no task waits for one text. A chunk owns the features that start in it and carries the ``n - 1`` words
after it to complete the last ones, so each feature is counted once. Counts and gains of chunks are
summed by document.

What meets is a count for each bucket and task, and the rows of the ranking: drawn documents are ranked by
ranges of the score that are sorted by themselves, each starting where those before it end.

Defined results: null and empty texts have no features and weight 0; very long texts are read whole; equal
texts have equal weights; rows that repeat an id have the same noise, and rank one after another; a null id
has the noise of the word ``null`` and ranks before others of the same score; empty tables give an empty
result or, as a target, gains that tell nothing apart but by frequency; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import cut, doc_texts
from helixframe.llm._words import IN_WORDS, split_words

#: Bytes of text that one chunk owns; longer texts are cut.
CHUNK = 1 << 16
#: Texts that are counted at once.
AT_ONCE = 2048


def chunks(text: str, n: int = 1, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """Parts of the text's words with the ``n - 1`` words after each, and how many words each part owns."""
    data = text.encode("utf-8", "surrogatepass").translate(IN_WORDS)
    at = 0
    while at < len(data):
        end = data.find(b" ", min(len(data), at + size))
        end = len(data) if end < 0 else end
        own, carried = data[at:end], []
        reach = end
        while len(carried) < n - 1 and reach < len(data):
            begin = reach
            reach = data.find(b" ", begin + 1)
            reach = len(data) if reach < 0 else reach
            carried += data[begin:reach].split()
        yield b" ".join([own, *carried]), len(own.split())
        at = end


def features(texts: pa.Array, owned: np.ndarray | None, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the bucket of each feature, and the words that each text owns; ``owned`` None: all."""
    words, bounds = split_words(texts)
    sizes = np.diff(bounds)
    owned = sizes if owned is None else owned
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(of)) - bounds[:-1][of]
    texts_of, found = [], []
    for k in range(1, n + 1):
        start = np.flatnonzero((place < owned[of]) & (place + k <= sizes[of]))
        if k == 1:
            grams = words.take(pa.array(start))
            names, which = words.dictionary, grams.indices.to_numpy()
        else:
            every = words.cast(pa.large_binary())
            grams = pc.binary_join_element_wise(*[every.take(pa.array(start + j)) for j in range(k)], pa.scalar(b" ", pa.large_binary())).dictionary_encode()
            names, which = grams.dictionary, grams.indices.to_numpy()
        hashed = np.fromiter(map(zlib.crc32, names.to_pylist()), np.int64, len(names)) % buckets
        texts_of.append(of[start])
        found.append(hashed[which] if len(start) else np.zeros(0, np.int64))
    return np.concatenate(texts_of), np.concatenate(found), owned


def _pieces(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Texts that are taken as they are, and the chunks of the others, dealt anew."""
    rows = doc_texts(docs)
    long_ = F.octet_length("text") > CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc_id, text in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                for k, (piece, own) in enumerate(chunks(text, n)):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "chunk": pa.array([k], pa.int64()), "doc_id": pa.array([doc_id], pa.int64()), "text": pa.array([piece], pa.binary()), "own": pa.array([own], pa.int64())})

    cut_up = rows.filter(long_).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, "row long, chunk long, doc_id long, text binary, own long")
    return rows.filter(~long_), cut_up.repartition("row", "chunk")


def bucket_counts(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """``bucket, n``: the features of all texts in each bucket that has any."""

    def counted(text: int, own: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(buckets, np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, AT_ONCE):
                    b = whole.slice(at, AT_ONCE)
                    held += np.bincount(features(b.column(text), None if own is None else b.column(own).to_numpy(), n, buckets)[1], minlength=buckets)
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["bucket", "n"])

        return run

    short, long_ = _pieces(docs, n)
    out = "bucket long, n long"
    every = short.mapInArrow(counted(1, None), out).unionByName(long_.mapInArrow(counted(3, 4), out))
    return every.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> np.ndarray:
    """The gain of each bucket, as many numbers as there are buckets."""
    table = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for name, held in (("s", docs), ("t", target.select(F.lit(None).alias("doc_id"), "text"))):
        table = table.join(bucket_counts(held, n, buckets).withColumnRenamed("n", name), "bucket", "left")
    table = cut(table.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t")]), buckets)
    total = table.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1) * F.lit(total.s + buckets).cast("double") / ((F.col("s") + 1) * F.lit(total.t + buckets).cast("double"))
    found = table.select("bucket", F.floor(F.lit(1000) * F.log(ratio)).alias("gain")).collect()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in found]] = [r.gain for r in found]
    return out


def weights(docs: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""

    def summed(text: int, own: int | None, kept: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, AT_ONCE):
                    b = whole.slice(at, AT_ONCE)
                    of, bucket, owned = features(b.column(text), None if own is None else b.column(own).to_numpy(), n, len(gain))
                    total = np.bincount(of, gain[bucket], b.num_rows)
                    made = [pa.array(x.astype(np.int64)) for x in (owned, np.bincount(of, minlength=b.num_rows), total)]
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *made], names=[*kept, "n_words", "n_features", "total"])

        return run

    short, long_ = _pieces(docs, n)
    sums = ["n_words", "n_features", "total"]
    out = "doc_id long, n_words long, n_features long, total long"
    whole = long_.mapInArrow(summed(3, 4, ["row", "doc_id"]), f"row long, {out}").groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in sums])
    every = short.mapInArrow(summed(1, None, ["doc_id"]), out).unionByName(whole.select("doc_id", *sums))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    return every.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def _ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows`` with ``rank`` from 1, highest score first, of the first ``drawn`` ones; null for the others."""
    placed = cut(rows.repartitionByRange(F.col("score").desc(), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
    at = F.monotonically_increasing_id()
    part, within = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.select("*", part.alias("part"), within.alias("within"))
    starts, before = [], 0
    for r in sorted(placed.groupBy("part").count().collect()):  # one row a partition
        starts.append((r["part"], before))
        before += r["count"]
    table = rows.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("within") + 1
    return placed.join(F.broadcast(table), "part", "left").select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; of those with ``least_words`` or more ``percent`` of a hundred are drawn."""
    found = weights(docs, gains(docs, target, n, buckets), n)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cut(found.withColumn("score", F.col("weight") + noise))
    able = scored.filter(F.col("n_words") >= least_words)
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    every = _ranked(able, percent * able.count() // 100).unionByName(rest)
    return every.select("doc_id", "n_features", "weight", "score", "rank")
