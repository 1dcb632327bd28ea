"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalake.llm import (
    conversation_trie,
    decontamination,
    fill_in_middle,
    hidden_markov,
    hilbert_neighbours,
    jaccard_join,
    language_id,
    licenses,
    quality,
    sentence_pieces,
    token_records,
    tool_calls,
    toxicity,
)
from annalake.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.from_conversations(table(spark, sf_dir, "conversations")))


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_neighbours.neighbours(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_records.token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 sound but toxic, 2 sound. Selected are texts that reach grade 1."""
    docs = table(spark, sf_dir, "documents")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    model = quality.fit(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"), grade)
    found = quality.rate(docs, model, reach=1)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail", "selected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    found = toxicity.detect(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_ids", "ids_crc32", "n_bytes", "same")


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = hidden_markov.fit(docs.where(hidden_markov.is_learned(F.col("doc_id"))))
    found = hidden_markov.score(docs, model).withColumn("held_out", ~hidden_markov.is_learned(F.col("doc_id")))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50, digests=True)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_tool_calls": op1_tool_calls,
    "op2_hilbert_neighbours": op2_hilbert_neighbours,
    "op3_decontamination": op3_decontamination,
    "op4_token_records": op4_token_records,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_license_scan": op9_license_scan,
    "op10_sentence_pieces": op10_sentence_pieces,
    "op11_hidden_markov": op11_hidden_markov,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_tool_calls": tool_calls.oracle(),
    "op8_jaccard_join": jaccard_join.oracle(),
    "op9_license_scan": licenses.oracle(),
    "op12_fill_in_middle": fill_in_middle.oracle(),
    "op13_conversation_trie": conversation_trie.oracle(),
}
