"""The registered queries of the operators on training data, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown, conversations, langid, mixing, order, phrases, quality, repeats
from . import resampling, simhash, toxicity, vectors
from .common import shared_path, ship

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op2_class_lm(spark: SparkSession, sf: str) -> DataFrame:
    return brown.class_model_scores(_table(spark, sf, "documents"))


def op3_simhash_vptree(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(_table(spark, sf, "documents"))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op6_training_order(spark: SparkSession, sf: str) -> DataFrame:
    return order.training_order(_table(spark, sf, "documents"), shared_path(spark, "shards"))


def op7_snapshot_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.maximal_conversations(_table(spark, sf, "conversations"))


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf, "documents"), public_tokenizers.path(VOCABULARY),
                       public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents"))


def op10_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf, "embeddings"))


def op11_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeat_report(_table(spark, sf, "documents"))


def op12_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.phrases(_table(spark, sf, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_class_lm": op2_class_lm,
    "op3_simhash_vptree": op3_simhash_vptree,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_training_order": op6_training_order,
    "op7_snapshot_collapse": op7_snapshot_collapse,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_mixing": op9_mixing,
    "op10_near_vectors": op10_near_vectors,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_resampling": op12_resampling,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op7_snapshot_collapse": conversations.SQL,
    "op10_near_vectors": vectors.SQL,
    "op11_repeated_passages": repeats.SQL,
    "op12_resampling": resampling.SQL,
    "op13_phrases": phrases.SQL,
}
