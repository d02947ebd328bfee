"""From raw documents to packed training sequences: five stages, each written and read again by ``run``.

Every stage but the last returns the columns of ``documents``; the last returns a row for each
packed piece. Documents that a stage rejects are gone for the stages after it.

Defined results of every stage: a null text counts as empty and is kept as null; very long texts are
read whole; rows without an id or with a repeated one are judged by their own texts; equal texts fare
alike; extra columns, whatever their names, pass through all stages but the last, which ignores
them; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.deploy import ship
from helixframe.llm import near_copies, packing, quality, stream_dedup, toxicity
from helixframe.llm._shared import shared_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good stay."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger predicts to be toxic go."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest ``doc_id`` stays."""
    return stream_dedup.keep_latest(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that SimHash BK-trees find and whose five-word Jaccard similarity is 0.8 or more the row with the smallest ``doc_id`` stays."""
    ship(spark)
    return near_copies.keep_one(docs, shingle=5, least=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences and offsets."""
    ship(spark)
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("best-fit packing", pack),
]

#: The classifiers, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes through Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs
