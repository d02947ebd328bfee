"""Alignments: the fact table of everything downstream.

``aln_id, ref_id, qry_id, ref_len, qry_len, s1, e1, s2, e2, errors, sim_errors, stops, deltas``;
coordinates from 1 on the forward strand, start beyond end on the reverse. ``deltas`` are signed
distances to the next indel: +d a base that only the reference has, -d one that only the query has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "aln_id long, ref_id string, qry_id string, ref_len long, qry_len long, s1 long, e1 long, s2 long, e2 long, errors long, sim_errors long, stops long, deltas array<long>, data_type string"


def with_identity(rows: DataFrame) -> DataFrame:
    """Add ``total`` columns and ``idy, sim, stp`` percentages."""
    span = F.abs(F.col("e1") - F.col("s1")) + 1
    base = F.when(F.col("data_type") == "protein", F.floor(span / 3)).otherwise(span)
    total = base + F.size(F.filter("deltas", lambda d: d < 0))
    rows = rows.withColumn("total", total.cast("long"))
    return rows.withColumn("idy", (F.col("total") - F.col("errors")) * 100.0 / F.col("total")).withColumn("sim", (F.col("total") - F.col("sim_errors")) * 100.0 / F.col("total")).withColumn("stp", F.col("stops") * 100.0 / (2 * F.col("total")))


def with_bounds(rows: DataFrame) -> DataFrame:
    """Add ``lo1, hi1, lo2, hi2`` (low and high end on each side), ``dir1, dir2``."""
    return (
        rows.withColumn("lo1", F.least("s1", "e1")).withColumn("hi1", F.greatest("s1", "e1")).withColumn("lo2", F.least("s2", "e2")).withColumn("hi2", F.greatest("s2", "e2"))
        .withColumn("dir1", F.when(F.col("s1") <= F.col("e1"), 1).otherwise(-1)).withColumn("dir2", F.when(F.col("s2") <= F.col("e2"), 1).otherwise(-1))
    )


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """Delta files: a header of two paths and a word for the data type (with P: protein), then records ``>ref qry len len`` of alignments.

    Records are split where a line begins with ``>``, so a file is read by many tasks; only the two
    lines before the first record are looked at apart.
    """
    chunks = spark.read.option("lineSep", "\n>").text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    head = chunks.filter(F.col("value").rlike(r"^[^\n]+\n[A-Z]+\s*$")).select(F.regexp_extract("value", r"\n([A-Z]+)\s*$", 1)).limit(1).collect()
    kind = "protein" if head and head[0][0].startswith("P") else "dna"

    return chunks.mapInArrow(lambda batches: _parsed(batches, kind), SCHEMA)


#: Alignments that a task holds at once while it reads records.
AT_ONCE = 10000


def _parsed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Alignments of records ``value, ord``, a bounded number at once, however many a record has."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 9, pa.list_(pa.int64()), pa.string()]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
    out = []
    for b in batches:
        for value, order in zip(b.column(0), b.column(1), strict=True):
            lines, order = value.as_py().lstrip(">").split("\n"), order.as_py()
            first = lines[0].split()
            if len(first) != 4 or not first[2].isdigit():
                continue  # the file's header
            at, k = 1, 0
            while at < len(lines):
                cells = lines[at].split()
                at += 1
                if len(cells) != 7:
                    continue
                deltas = []
                while at < len(lines) and (step := lines[at].strip()) != "0":
                    deltas.append(int(step))
                    at += 1
                at += 1
                out.append((_id(order, k), first[0], first[1], int(first[2]), int(first[3]), *map(int, cells), deltas, kind))
                k += 1
                if len(out) == AT_ONCE:
                    yield made(out)
                    out = []
    if out:
        yield made(out)


def _id(order: int, k: int) -> int:
    """Of the k-th alignment of a record: up to 2^20 partitions, 2^23 records in each and 2^20 alignments in a record have ids of their own.

    Numbers beyond that fail instead of wrapping round.
    """
    partition, place = order >> 33, order & ((1 << 33) - 1)
    if partition >= 1 << 20 or place >= 1 << 23 or k >= 1 << 20:
        raise OverflowError("more records or alignments in a partition than ids can tell apart")
    return partition << 43 | place << 20 | k


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up alignments table: every value an integer expression of ``lineitem``'s keys, without deltas."""
    k, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    keys = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    rows = keys.select(
        (((k * 10 + n) * 100000 + p) * 10000 + s).alias("aln_id"), F.concat(F.lit("r"), (s % 20).cast("string")).alias("ref_id"), F.concat(F.lit("q"), (p % 50).cast("string")).alias("qry_id"),
        F.lit(100000).cast("long").alias("ref_len"), F.lit(50000).cast("long").alias("qry_len"),
        (1 + (k * 7919 + n * 104729) % 90000).alias("s1"), (50 + (p * 31 + n * 17) % 2000).alias("span"), (1 + (k * 6101 + s * 13) % 45000).alias("q0"), (k % 7 - 3).alias("d"), ((k + n) % 4 == 0).alias("rev"),
        ((k + n) % 40).alias("errors"), (n % 3).cast("long").alias("stops"),
    )
    rows = rows.withColumn("e1", F.col("s1") + F.col("span") - 1).withColumn("q1", F.col("q0") + F.col("span") + F.col("d") - 1)
    return rows.select(
        "aln_id", "ref_id", "qry_id", "ref_len", "qry_len", "s1", "e1", F.when(F.col("rev"), F.col("q1")).otherwise(F.col("q0")).alias("s2"), F.when(F.col("rev"), F.col("q0")).otherwise(F.col("q1")).alias("e2"),
        "errors", (F.col("errors") - F.col("errors") % 3).alias("sim_errors"), "stops", F.array().cast("array<long>").alias("deltas"), F.lit("dna").alias("data_type"),
    )


#: The same table in SQL, for use as ``WITH aln AS (...)``.
FROM_LINEITEM_SQL = """
aln AS (
  SELECT aln_id, ref_id, qry_id, 100000::BIGINT AS ref_len, 50000::BIGINT AS qry_len, s1, s1 + span - 1 AS e1,
         CASE WHEN rev THEN q0 + span + d - 1 ELSE q0 END AS s2, CASE WHEN rev THEN q0 ELSE q0 + span + d - 1 END AS e2,
         errors, errors - errors % 3 AS sim_errors, stops, span AS total
  FROM (
    SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS aln_id, 'r' || (l_suppkey % 20) AS ref_id, 'q' || (l_partkey % 50) AS qry_id,
           1 + (l_orderkey * 7919 + l_linenumber * 104729) % 90000 AS s1, 50 + (l_partkey * 31 + l_linenumber * 17) % 2000 AS span,
           1 + (l_orderkey * 6101 + l_suppkey * 13) % 45000 AS q0, l_orderkey % 7 - 3 AS d, (l_orderkey + l_linenumber) % 4 = 0 AS rev,
           (l_orderkey + l_linenumber) % 40 AS errors, (l_linenumber % 3)::BIGINT AS stops
    FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem))
), b AS (
  SELECT *, least(s1, e1) AS lo1, greatest(s1, e1) AS hi1, least(s2, e2) AS lo2, greatest(s2, e2) AS hi2,
         CASE WHEN s1 <= e1 THEN 1 ELSE -1 END AS dir1, CASE WHEN s2 <= e2 THEN 1 ELSE -1 END AS dir2,
         (total - errors) * 100.0::DOUBLE / total AS idy, (total - sim_errors) * 100.0::DOUBLE / total AS sim, stops * 100.0::DOUBLE / (2 * total) AS stp
  FROM aln
)
"""
