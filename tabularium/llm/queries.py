"""The queries of the corpus operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, importance, language, licenses, media, mixing, negatives, quality, secrets, simhash, token_shards, toxicity, winnowing


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.with_media(documents(spark, sf_dir))).drop("problem")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.document_toxicity(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=changed)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.with_next(spark, documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_token_shards, op2_quality, op3_media_columns, op4_language, op5_simhash, op6_licenses, op7_secrets, op8_mixing, op9_toxicity, op10_decontamination, op11_importance, op12_hard_negatives, op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op7_secrets": secrets.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op10_decontamination": decontaminate.ORACLE_SQL, "op11_importance": importance.ORACLE_SQL, "op12_hard_negatives": negatives.ORACLE_SQL}
