"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared checkpoint
folder and reads it again as the next one's documents.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm import decontaminate, language, mixing, simhash, token_shards
from tabularium.llm.common import free_name, key_remainder, quoted, remove, shared_dir

#: SQL can't express the stages that learn, hash or tokenise; tests compare them with brute force.
ORACLE_SQL = None


def _own(docs: DataFrame) -> list:
    return [quoted(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go, and no others, even if there is no language to learn.

    A null, empty or blank text goes; a long one is read whole; repeated rows and null keys stay; an empty table gives
    none; all columns are kept as they are.
    """
    model = language.train(spark, docs.where(key_remainder("doc_id", 4) != 2))
    model = model if model.languages else language.Model(["any"], np.zeros(1), np.zeros((language.BUCKETS, 1), np.float32))
    found = free_name(docs, "found")
    rows = docs.select("*", language.prediction(spark, quoted("text"), model).alias(found))
    return rows.where(F.col(found).getField("lang_pred") != language.UNDETERMINED).select(_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the smallest doc_id (null last) and, where rows share it, the least hash of the text.

    Null, empty and blank texts are one group; of rows alike in key and text any one stays; an empty table gives none; all
    columns are kept as they are.
    """
    row = free_name(docs, "row")
    key, text = quoted("doc_id").cast("string"), quoted("text").cast("string")
    sized = F.concat(F.length(key).cast("string"), F.lit(":"), key)  # so that no two keys and texts join alike
    rows = docs.withColumn(row, F.md5(F.concat(F.coalesce(sized, F.lit("-")), F.coalesce(F.concat(F.lit("="), text), F.lit("-")))))
    return rows.join(simhash.first_rows(rows, row), row, "left_semi").dropDuplicates([row]).select(_own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark.

    Texts without words, null ones too, stay; a long one is searched whole; repeated rows and null keys stay; with an empty
    benchmark all stay; an empty table gives none; all columns are kept as they are.
    """
    found = free_name(docs, "found")
    rows = docs.select("*", decontaminate.contamination(spark, quoted("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).alias(found))
    return rows.where(~F.col(found).getField("contaminated")).select(_own(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source; texts without words may be taken; repeated rows are dealt with one by one; an empty table
    gives none; all columns are kept as they are.
    """
    mixed = mixing.mix(docs, rows_as="row").where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the documents, as read back.

    A null or empty text is one end id; copies of a key are records of their own; null keys come first; an empty table
    gives none; columns other than key and text end here.
    """
    return token_shards.token_shards(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing sources", source_mixing), ("token shards", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has written goes once the next one's is complete."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{root}/stage-{i}")
        docs = spark.read.parquet(f"{root}/stage-{i}")
        if i:
            remove(spark, f"{root}/stage-{i - 1}")
    return docs
