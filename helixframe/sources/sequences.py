"""Sequences: ``seq_set, seq_id, ord, seq, len, qual``, from FASTA, FASTQ, tables, and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequence import clean_letters, dna_view, first_token

SCHEMA = "seq_set string, seq_id string, ord long, seq string, len long, qual string"


def _lines(spark: SparkSession, path: str, start: str) -> DataFrame:
    """One row a record: records are split where a line begins with ``start``, so no file is read by one task alone."""
    whole = spark.read.option("lineSep", "\n" + start).text(path)
    return whole.select(F.regexp_replace("value", "^" + start, "").alias("record"), F.monotonically_increasing_id().alias("ord")).filter(F.trim("record") != "")


def read_fasta(spark: SparkSession, path: str, seq_set: str = "", clean: str = "lower") -> DataFrame:
    """Records of FASTA files. ``clean``: ``lower`` keeps all but white space, ``letters`` also turns non-letters into x, ``none`` keeps case."""
    rows = _lines(spark, path, ">")
    header, body = F.substring_index("record", "\n", 1), F.expr("substring(record, instr(record, '\n') + 1)")
    body = F.when(F.instr("record", "\n") > 0, body).otherwise("")
    seq = {"lower": F.lower(F.regexp_replace(body, r"\s", "")), "letters": clean_letters(body), "none": F.regexp_replace(body, r"\s", "")}[clean]
    return rows.select(F.lit(seq_set).alias("seq_set"), first_token(header).alias("seq_id"), "ord", seq.alias("seq")).withColumn("len", F.length("seq").cast("long")).withColumn("qual", F.lit(None).cast("string"))


def read_fastq(spark: SparkSession, path: str, seq_set: str = "") -> DataFrame:
    """Records of four-line FASTQ files; a record whose qualities and bases differ in number is an error."""
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.shiftright(at, 33).alias("_part"), at.alias("_at"))
    from pyspark.sql import Window

    # a record is four lines in a row: each partition's lines of a file are counted, and numbered from where those before end
    parts = lines.groupBy("f", "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("f").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("f", "_part", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = lines.join(starts, ["f", "_part"]).select("f", "value", (F.col("_start") + F.col("_at") - F.col("_from")).alias("n"))
    rows = numbered.groupBy("f", F.floor(F.col("n") / 4).alias("ord")).agg(*[F.max(F.when(F.col("n") % 4 == i, F.col("value"))).alias(c) for i, c in enumerate(("head", "bases", "plus", "qual"))])
    checked = F.when(F.length("bases") == F.length("qual"), F.lower(F.col("bases"))).otherwise(F.raise_error(F.concat(F.lit("qualities and bases differ: "), "head")).cast("string"))
    return rows.select(F.lit(seq_set).alias("seq_set"), F.regexp_extract("head", r"^@\s*(\S+)", 1).alias("seq_id"), "ord", checked.alias("seq"), F.length("bases").cast("long").alias("len"), "qual")


def read_sequences(spark: SparkSession, path: str, seq_set: str = "") -> DataFrame:
    """FASTA or FASTQ, told by the first character."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    kind = first[0][0][:1] if first else ">"
    if kind not in (">", "@"):
        raise ValueError(f"{path} is neither FASTA nor FASTQ")
    return read_fasta(spark, path, seq_set) if kind == ">" else read_fastq(spark, path, seq_set)


def from_table(df: DataFrame, id_column: str, text: Column, seq_set: str) -> DataFrame:
    """Any table's texts as sequences."""
    seq = F.coalesce(text, F.lit(""))
    return df.select(F.lit(seq_set).alias("seq_set"), F.col(id_column).cast("string").alias("seq_id"), F.col(id_column).cast("long").alias("ord"), seq.alias("seq"), F.length(seq).cast("long").alias("len"), F.lit(None).cast("string").alias("qual"))


def table(spark: SparkSession, sf_dir: str, name: str, dna: bool = False) -> DataFrame:
    """``documents`` or ``benchmark`` as lower-cased text sequences, or as DNA."""
    key = {"documents": "doc_id", "benchmark": "item_id"}[name]
    text = F.col("text")
    return from_table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key, dna_view(text) if dna else F.lower(text), name)


def sub_range(seqs: DataFrame, start: int, end: int) -> DataFrame:
    """The bases ``start``..``end`` of every sequence."""
    return seqs.withColumn("seq", F.substring("seq", start, end - start + 1)).withColumn("len", F.length("seq").cast("long"))


def sizes(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", "len")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """``seq_id, len, reverse`` from lines ``id len [+-]``."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).filter(F.size("c") >= 2)
    return rows.select(F.col("c")[0].alias("seq_id"), F.col("c")[1].cast("long").alias("len"), F.coalesce(F.try_element_at("c", F.lit(3)) == "-", F.lit(False)).alias("reverse"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """The nine tab-separated columns of features."""
    names = "seq_id string, source string, feature string, start long, end long, score string, strand string, frame string, gene string"
    return spark.read.csv(path, sep="\t", schema=names, comment="#")
