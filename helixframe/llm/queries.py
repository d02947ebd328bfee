"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import id_store, importance, lexical, minhash, packing, piece_codec, quality, quartile_digest, sharding, simhash, stream_dedup, token_counts, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.document_fingerprints(_documents(spark, sf_dir))


def op4_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_groups(_documents(spark, sf_dir))


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.minimax_shards(_documents(spark, sf_dir), shards=40)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_store.through_store(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.scores(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_quartile_digest": op3_quartile_digest,
    "op4_stream_dedup": op4_stream_dedup,
    "op5_minimax_shards": op5_minimax_shards,
    "op6_piece_codec": op6_piece_codec,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_id_store": op8_id_store,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_minhash": op11_minhash,
    "op12_importance": op12_importance,
    "op13_lexical": op13_lexical,
}
ORACLE_SQL: dict[str, str] = {"op4_stream_dedup": stream_dedup.ORACLE_SQL, "op11_minhash": minhash.ORACLE_SQL, "op13_lexical": lexical.ORACLE_SQL}
