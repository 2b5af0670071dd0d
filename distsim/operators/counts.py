"""Pair counts with word and pair frequency thresholds.

Pairs are counted once, with partial aggregation; the counts of targets and contexts
are sums of the counted pairs. All branches read the same shuffle of counted
pairs: the filters below are written so that the optimizer does not push a different
predicate into each branch, which would make Spark scan the corpus once per branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("target", "context")


def count_pairs(pairs: DataFrame) -> DataFrame:
    """Occurrences of each (target, context), unfiltered."""
    return (
        pairs.where(F.col("target").isNotNull() & F.col("context").isNotNull())
        .groupBy("target", "context")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _frequent(counted: DataFrame, role: str, min_freq: int) -> DataFrame:
    words = counted.groupBy(F.col(role).alias("word")).agg(F.sum("n").alias("n"))
    # One predicate over word and sum: a bare length test would be pushed below the
    # shuffle of counted pairs.
    return words.where(F.when(F.length("word") > 1, F.col("n")) > min_freq)


def target_counts(counted: DataFrame, min_freq: int = 0) -> DataFrame:
    """Targets longer than one character seen more than ``min_freq`` times."""
    return _frequent(counted, "target", min_freq)


def context_counts(counted: DataFrame, min_freq: int = 0) -> DataFrame:
    """Contexts longer than one character seen more than ``min_freq`` times."""
    return _frequent(counted, "context", min_freq)


def word_counts(counted: DataFrame) -> DataFrame:
    """word, target_n, context_n: how often a word is a target and a context, in one pass."""
    sides = [
        F.struct(F.col(role).alias("word"),
                 *[F.when(F.lit(role == r), F.col("n")).alias(f"{r}_n") for r in ROLES])
        for role in ROLES
    ]
    return counted.select(F.inline(F.array(*sides))).groupBy("word").agg(
        *[F.sum(f"{r}_n").alias(f"{r}_n") for r in ROLES])


def keep_frequent(counted: DataFrame, targets: DataFrame, contexts: DataFrame) -> DataFrame:
    """Counted pairs whose words are in the two vocabularies.

    Each word is there once, so an inner join keeps or drops a pair. A semi join would
    say so more plainly, but the optimizer moves it below the counting, and the corpus
    is then tokenized twice. A partition's part of a vocabulary is hashed, which spares sorting
    the pairs; adaptive execution splits the rows of a frequent word.
    """
    vocabularies = [
        (role, words.select(F.col("word").alias(role)).hint("shuffle_hash"))
        for role, words in zip(ROLES, (targets, contexts))
    ]
    for role, words in vocabularies:
        counted = counted.join(words, role)
    return counted.select("target", "context", "n")


def filtered_pairs(counted: DataFrame, min_freq: int = 0) -> DataFrame:
    """Counted pairs whose target and context both pass the frequency threshold.

    ``n`` is the number of occurrences the row stands for. Both vocabularies read one shuffle
    of word counts: the filter needs all its columns, so neither branch prunes any, and a word
    depends on its counts, so no test of it is pushed below them.
    """
    words = word_counts(counted).where(
        F.when(F.length("word") > 1, F.greatest("target_n", "context_n")) > min_freq)
    targets, contexts = (
        words.select(F.when(F.col(f"{r}_n") > min_freq, F.col("word")).alias("word"))
        for r in ROLES
    )
    return keep_frequent(counted, targets, contexts)


def shared_once(pair_counts: DataFrame) -> DataFrame:
    """Pair counts behind a shuffle that every branch of a plan can reuse.

    Operators that read the pairs several times (for totals, for marginals, for the pairs
    themselves) start here, so that counting and filtering run once. Both columns are
    keys, which spreads the rows of a frequent word; their order differs from that of
    the counting shuffle, or Spark would drop this one as redundant. Nulls are dropped
    here because each branch would otherwise push its own test for them below.
    """
    rows = pair_counts.select("target", "context", "n").dropna()
    return rows.repartition("context", "target")


def pair_counts(pairs: DataFrame, min_freq: int = 0, min_pair: int = 1) -> DataFrame:
    """Count pairs, drop rare words, then drop pairs seen fewer than ``min_pair`` times."""
    return filtered_pairs(count_pairs(pairs), min_freq).where(F.col("n") >= min_pair)
