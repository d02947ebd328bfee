"""Seeds: the windows of a fixed length in each sequence, as 64-bit hashes taken batch-wise.

A window's hash is polynomial over code points and built by doubling, so that a sequence costs
about ``log2(length)`` vector operations. Equal windows have equal hashes; whoever joins on the
hash checks the letters afterwards where both sequences are at hand.

A join takes sampled seeds: of each ``length`` letters the shorter window whose mixed hash is least (the first
of equals). The same letters choose the same window wherever they are, so any two equal stretches
of at least ``length`` letters share a seed, and one at least every ``length - seed + 1`` letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "seq_id string, pos long, kmer long"


#: Texts that a worker has decoded at once.
AT_ONCE = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that a worker holds no more of them decoded."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(letters: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of ``length`` letters, in order of its start."""
    n = len(letters) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        unit = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        unit ^= unit >> np.uint64(32)
        whole, done, part, width, power = None, 0, unit, 1, BASE
        left = length
        while left:
            if left & 1:
                shifted = part[done : done + n]
                whole = shifted.copy() if whole is None else whole * power + shifted
                done += width
            left >>= 1
            if left:
                part = part[: len(part) - width] * power + part[width:]
                width *= 2
                power = power * power
        return whole


def extract(seqs: DataFrame, length: int, nucleotides_only: bool = False) -> DataFrame:
    """``seq_id, pos`` (from 1), ``kmer`` of every window; with ``nucleotides_only`` of those of acgt alone."""
    import re

    other = re.compile("[^acgt]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for seq_id, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hashes = window_hashes(code_points(seq), length)
                pos = np.arange(1, len(hashes) + 1)
                if nucleotides_only and len(hashes):
                    bad = np.zeros(len(seq) + 1, np.int64)
                    for m in other.finditer(seq):
                        bad[m.start() + 1] = 1
                    bad = np.cumsum(bad)
                    keep = bad[length:] == bad[: len(hashes)]
                    hashes, pos = hashes[keep], pos[keep]
                if len(hashes):
                    yield pa.RecordBatch.from_arrays([pa.array([seq_id] * len(hashes), pa.string()), pa.array(pos), pa.array(hashes.view(np.int64))], names=["seq_id", "pos", "kmer"])

    return seqs.select("seq_id", F.coalesce("seq", F.lit("")).alias("seq")).mapInArrow(run, SCHEMA)


def seed_length(length: int) -> int:
    """Letters of a sampled seed for matches of ``length``: about half of them, but 16 where there are as many, so that chance hits stay few."""
    return max(length // 2 + 1, min(length, 16))


def sampled_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """Where the least mixed hash of any ``span`` neighbours is, the first of equals."""
    if not len(hashes) or span <= 1:
        return np.arange(len(hashes))
    mixed = hashes * np.uint64(0x9FB21C651E98DF25)
    mixed ^= mixed >> np.uint64(28)
    n = len(mixed) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    found = []
    for at in range(0, n, 1 << 16):  # the windows' views are looked at in parts
        some = np.lib.stride_tricks.sliding_window_view(mixed[at : at + (1 << 16) + span - 1], span)[: n - at]
        found.append(some.argmin(axis=1) + np.arange(at, at + len(some)))
    return np.unique(np.concatenate(found))


def sampled(seqs: DataFrame, length: int, seed: int | None = None) -> DataFrame:
    """``seq_id, pos`` (from 1), ``kmer`` of seeds that every two equal stretches of ``length`` letters share; ``seed`` equal to ``length``: of every window."""
    seed = seed or seed_length(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for seq_id, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hashes = window_hashes(code_points(seq), seed)
                pos = sampled_places(hashes, length - seed + 1)
                if len(pos):
                    yield pa.RecordBatch.from_arrays([pa.array([seq_id] * len(pos), pa.string()), pa.array(pos + 1), pa.array(hashes[pos].view(np.int64))], names=["seq_id", "pos", "kmer"])

    return seqs.select("seq_id", F.coalesce("seq", F.lit("")).alias("seq")).mapInArrow(run, SCHEMA)


def save(seeds: DataFrame, path: str, buckets: int = 64) -> None:
    """Keep seeds for later runs, in ``buckets`` ranges of the hash."""
    seeds.withColumn("bucket", F.pmod("kmer", F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket", "kmer").write.partitionBy("bucket").mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
