"""Exact deduplication by a stateful stream, with DataFrame and SQL functions only.

The rows' digests, with each row's stable identifier (``doc_id``) and content locator (input file
and row in it, both as longs), are landed as a narrow table in the shared folder and streamed from
there in micro-batches. The state is keyed by digest, kept by the disk-backed state store, and has
no watermark, so nothing expires: per digest it holds how many rows were seen, the identifier of
the row that stays and the locator of its content. A micro-batch's rows are pre-aggregated before
they are dealt by digest. Every digest that was hit again is then checked on full bytes: texts are
grouped by digest and whole text, and the locator that the state kept must be that of the one text
of its digest. Rows whose digest stands for another text than the located one take the groups of
their texts instead. The stream runs in a session of its own, so that its settings reach no other.

Defined results: a null text counts as empty; texts are equal when their bytes are; of equal texts
the row with the largest ``doc_id`` stays (null loses to any); rows repeated with that ``doc_id``
are all marked as kept in the report, and ``keep_latest`` keeps one of them; an empty table gives
an empty result; columns other than ``doc_id`` and ``text`` are ignored by the report and passed
through by ``keep_latest``; very long texts are hashed and compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm._shared import join_counted, shared_path

DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A state store takes about 4 MB of disk before it holds a row, so their number follows the rows and not the shuffle's partitions.
STORES = "spark.sql.streaming.internal.stateStore.partitions"
ROWS_PER_STORE = 500_000
#: Plain create and rename; the default asks a local file system for links, by a process of its own for each file.
FILES = "spark.sql.streaming.checkpointFileManagerClass"
PLAIN_FILES = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
LEAST_STORES = 16
LANDED = "digest binary, doc_id long, file long, row long"
Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(docs: DataFrame) -> DataFrame:
    """``doc_id, text, file, row``; rows that don't come straight from files are located by their place in the plan's partitions."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    by_place = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    if not docs.inputFiles():
        return by_place
    try:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # the plan below has dropped the file columns
        return by_place


def seen(spark: SparkSession, landed: str, checkpoint: str, out: str, stores: int = LEAST_STORES, batch_bytes: int = 256 << 20) -> None:
    """Stream what has landed through the keyed state; the groups that a micro-batch changed are appended to ``out``.

    Started again with the same ``checkpoint`` it goes on with the state as it was, over new files only.
    """
    settings = {PROVIDER: DISK_STATE, STORES: str(stores), FILES: PLAIN_FILES, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    own = spark.newSession()
    for k, v in settings.items():
        own.conf.set(k, v)
    rows = own.readStream.schema(LANDED).option("maxBytesPerTrigger", batch_bytes).parquet(landed)
    newest = F.max(F.struct("doc_id", "file", "row"))
    state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), newest.alias("keep"))

    def keep(changed: DataFrame, batch: int) -> None:  # a place of its own for each batch: doing it again changes nothing
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def exact_groups(docs: DataFrame, digest: Digest = sha256, batch_bytes: int = 256 << 20) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, a row for each row of ``docs``."""
    spark = docs.sparkSession
    home = shared_path(spark, "dedup")
    landed, out = f"{home}/landed", f"{home}/groups"
    located = _located(docs).withColumn("digest", digest(F.col("text")))
    located.select("digest", "doc_id", "file", "row").write.parquet(landed)
    rows = spark.read.schema(LANDED).parquet(landed)
    total = rows.count()
    seen(spark, landed, f"{home}/state", out, max(LEAST_STORES, total // ROWS_PER_STORE), batch_bytes)
    changed = "digest binary, n long, keep struct<doc_id: long, file: long, row: long>"
    groups = spark.read.schema(changed).parquet(out) if _any(spark, out) else spark.createDataFrame([], changed)
    groups = groups.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"))
    hits = groups.filter("n > 1").select("digest", F.col("keep").alias("held"))
    # full bytes: equal texts meet before they are dealt; each digest that was hit stands for the located text and no other
    texts = located.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    others = texts.join(hits, "digest").filter(~F.col("keep").eqNullSafe(F.col("held")))
    if digest is sha256 and others.isEmpty():
        joined = join_counted(rows, groups.select("digest", "n", F.col("keep.doc_id").alias("keep_id")), "digest", "n", total)
        return _report(joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), "digest"), F.lower(F.hex("digest")))
    # different texts behind one digest, or a digest that isn't SHA-256: the texts themselves are the keys
    whole = located.groupBy("text").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    return _report(join_counted(located, whole, "text", "group_size", total).select("doc_id", "keep_id", "group_size", "text"), F.sha2("text", 256))


def _any(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _report(rows: DataFrame, shown: Column) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), shown.alias("text_sha256"))


def keep_latest(docs: DataFrame, batch_bytes: int = 256 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text."""
    kept = exact_groups(docs, batch_bytes=batch_bytes).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("_own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = rows.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi")
    return found.dropDuplicates(["_doc", "_own"]).select("_row.*")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
