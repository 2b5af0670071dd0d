"""A training-data pipeline over ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows it is given, and returns a
DataFrame, which is written as Parquet and read again as the next stage's input. All stages
but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from distsim.llm import bpe, langid, mixing, quality, simhash
from distsim.llm.common import free_names, set_aside, ship, stored

MIN_LANGUAGE_SCORE = 0.5
VOCABULARY = "byte_bpe_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labels know, with a score of at least one half."""
    ship(spark)
    model = langid.fit(docs)
    lang, = free_names(docs, "lang")
    found = docs.withColumn(lang, langid.language(F.col("text"), model))
    kept = (F.col(f"{lang}.lang") != langid.UNKNOWN) & (
        F.col(f"{lang}.score") >= MIN_LANGUAGE_SCORE)
    return found.where(kept).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    table = quality.ratio_table(docs, quality.trusted_ids(labels))
    rows, restored = set_aside(docs, "doc_id", "text")
    return restored(quality.with_quality(rows, table).where("quality_rules.kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id, rows without one last.

    Near copies share 0.8 of their 5-word shingles (Jaccard) with one of the group. Rows are told
    apart by a stored number, whatever their ids; rows without words are copies of each other.
    """
    ship(spark)
    row, = free_names(docs, "row")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = simhash.near_copies(keyed.select(F.col(row).alias("id"), "text"))
    ids = keyed.select(F.col(row).alias("id"), F.col("doc_id").alias("own"))
    first = groups.join(ids, "id").groupBy("component").agg(
        F.min(F.struct(F.col("own").isNull().alias("none"), "own", "id")).alias("first"))
    kept = first.select(F.col("first.id").alias(row))
    return keyed.join(kept, row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids of every document, digests of the ids and of the decoded bytes."""
    ship(spark)
    return bpe.encoded(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

# The stages fit classifiers and search graphs, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
