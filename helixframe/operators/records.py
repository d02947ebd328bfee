"""Verbs over whole sequence records: sizes, order, pick, split, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement_iupac


def one_line(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), "seq_id").alias("header"), "seq")


def head(seqs: DataFrame, n: int) -> DataFrame:
    return seqs.orderBy("ord").limit(n)


def tail(seqs: DataFrame, n: int) -> DataFrame:
    return seqs.orderBy(F.col("ord").desc()).limit(n)


def turned(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("seq", reverse_complement_iupac(F.col("seq")))


def extract(seqs: DataFrame, ids: DataFrame, inverted: bool = False) -> DataFrame:
    return seqs.join(ids.select("seq_id").distinct(), "seq_id", "left_anti" if inverted else "left_semi")


def header_grep(seqs: DataFrame, pattern: str, inverted: bool = False) -> DataFrame:
    hit = F.col("seq_id").rlike(pattern)
    return seqs.filter(~hit if inverted else hit)


def data_grep(seqs: DataFrame, pattern: str, inverted: bool = False) -> DataFrame:
    hit = F.col("seq").rlike(pattern)
    return seqs.filter(~hit if inverted else hit)


def by_header(seqs: DataFrame) -> DataFrame:
    return seqs.orderBy("seq_id")


def by_data(seqs: DataFrame) -> DataFrame:
    return seqs.orderBy("seq", "seq_id")


def shuffled(seqs: DataFrame, seed: int = 0) -> DataFrame:
    return seqs.orderBy(F.xxhash64("seq_id", F.lit(seed)))


def split(seqs: DataFrame, parts: int) -> DataFrame:
    """Add ``part``: records dealt to so many files in turn."""
    return seqs.withColumn("part", F.pmod("ord", F.lit(parts)).cast("int"))


def wrapped(seqs: DataFrame, width: int = 60, upper: bool | None = None) -> DataFrame:
    """``seq_id, lines``: sequences cut into lines, in either case."""
    seq = F.col("seq") if upper is None else F.upper("seq") if upper else F.lower("seq")
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("seq") - 1) / width)).cast("int")), lambda i: F.substring(seq, i * width + 1, F.lit(width)))
    return seqs.select("seq_id", lines.alias("lines"))
