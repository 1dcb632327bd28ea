"""Documents to token ids in five stages, each written as Parquet and read again.

Toxic documents go, then those without a language, then all but one of each
group of near-duplicates, then those that hold passages of the benchmark. What
is left is encoded, and decoded again to compare.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalake.llm import decontamination, jaccard_join, language_id, sentence_pieces, toxicity
from annalake.llm.common import held_out, scratch, table


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    model = toxicity.fit(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    return language_id.identified(docs, model)


def keep_different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return jaccard_join.one_of_each(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def as_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32, n_bytes, same of every document."""
    return sentence_pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", keep_civil),
    ("language_id", keep_identified),
    ("jaccard_join", keep_different),
    ("decontamination", keep_unseen),
    ("sentence_pieces", as_token_ids),
]

#: SQL can't express the models; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
