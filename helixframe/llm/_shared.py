"""What the operators share: where lineage is cut, and how rows are laid out in global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a folder is made on this machine, and only if all executors run on
    it (a local master); on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            root = context.getCheckpointDir().get()
        elif context.isLocal():
            root = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that one checkpoint file is to hold, where their number is known.
ROWS_PER_FILE = 50_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder now and go on from there, so that a lost executor costs no more than one step.

    With about how many ``rows`` it has, small results don't become a file for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty; whatever else ``docs`` has can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: A key with more than one in so many of all rows is hot.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, one row for each ``key``, whose column ``count`` says how many of the ``total`` rows have it.

    Fewer than ``HOT_SHARE`` keys can be hot; their table rows are broadcast, so that the rows of a
    hot key stay where they are. All others are joined by a shuffle.
    """
    hot = F.col(count) * HOT_SHARE > total
    own = [c for c in table.columns if c != key]
    held = table.filter(hot).select(F.col(key).alias("_hot_key"), F.struct(*own).alias("_hot"))
    marked = rows.join(F.broadcast(held), F.col(key) == F.col("_hot_key"), "left")
    at_once = marked.filter("_hot_key is not null").select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in own])
    rest = marked.filter("_hot_key is null").select(*rows.columns).join(table.filter(~hot), key).select(*rows.columns, *own)
    return at_once.unionByName(rest)


#: Bytes of text that one range of documents is to hold.
RANGE_BYTES = 64 << 20


def range_count(texts: DataFrame, most: int = RANGE_BYTES) -> int:
    """Into how many ranges ``texts`` are dealt: as many as shuffle partitions, more where a range would hold over ``most`` bytes."""
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(texts.sparkSession), -(-held // most))


def range_cuts(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values that split ``column`` into ranges of about equal counts."""
    if parts < 2:
        return []
    found = df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in found})


def numbered(df: DataFrame, keys: list[str], spread: Column, slices: int, name: str) -> DataFrame:
    """Add ``name``: a number from 0 without gaps within each of ``keys``, however hot a key is.

    Every key's rows are dealt over ``slices`` slices; a slice is numbered by itself and starts
    where the slices before it end. Only the counts, at most keys times ``slices`` rows, meet.
    """
    from pyspark.sql import Window

    dealt = df.withColumn("_slice", F.pmod(spread, F.lit(slices)).cast("int"))
    counts = dealt.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_slice").orderBy(*[c for c in df.columns if c not in keys])
    ranked = dealt.withColumn("_rank", F.row_number().over(within))
    return ranked.join(starts, [*keys, "_slice"]).withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_slice", "_start", "_rank")
