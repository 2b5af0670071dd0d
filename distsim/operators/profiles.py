"""Marginals, entropies and association profiles of counted pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from .counts import shared_once


def pair_total(pair_counts: DataFrame) -> DataFrame:
    """Sum of all pair counts, as one row."""
    return pair_counts.agg(F.sum("n").alias("total"))


def _links(pair_counts: DataFrame, role: str) -> DataFrame:
    return pair_counts.groupBy(F.col(role).alias("word")).agg(
        F.count(F.lit(1)).alias("links"), F.sum("n").alias("total")
    )


def target_links(pair_counts: DataFrame) -> DataFrame:
    """Number of distinct contexts and total count of each target.

    The links themselves stay in long form, as the rows of ``pair_counts``: one map per
    word would put all rows of a frequent word into one task.
    """
    return _links(pair_counts, "target")


def context_links(pair_counts: DataFrame) -> DataFrame:
    """Number of distinct targets and total count of each context."""
    return _links(pair_counts, "context")


def _entropies(pair_counts: DataFrame, role: str) -> DataFrame:
    return pair_counts.groupBy(F.col(role).alias("word")).agg(
        F.sum("n").alias("total"), M.entropy_aggregate(F.col("n")).alias("entropy")
    )


def target_profiles(pair_counts: DataFrame) -> DataFrame:
    """Total and entropy of each target."""
    return _entropies(pair_counts, "target")


def context_profiles(pair_counts: DataFrame) -> DataFrame:
    """Total and entropy of each context."""
    return _entropies(pair_counts, "context")


def pair_marginals(pair_counts: DataFrame) -> DataFrame:
    """Each pair with total and entropy of its target and of its context."""
    targets = target_profiles(pair_counts).select(
        F.col("word").alias("target"),
        F.col("total").alias("target_n"),
        F.col("entropy").alias("entropy_target"),
    )
    contexts = context_profiles(pair_counts).select(
        F.col("word").alias("context"),
        F.col("total").alias("context_n"),
        F.col("entropy").alias("entropy_context"),
    )
    return (
        pair_counts.join(targets, "target")
        .join(contexts, "context")
        .select(
            "target", "context", "n",
            "target_n", "entropy_target", "context_n", "entropy_context",
        )
    )


def profile_measures(marginals: DataFrame, total: DataFrame) -> DataFrame:
    """Association measures from pairs with marginals and a one-row grand total."""
    f, t, c = (F.col(x).cast("double") for x in ("n", "target_n", "context_n"))
    n = F.col("pair_total")
    rows = marginals.withColumn("pair_total", total.scalar().cast("double"))
    return rows.select(
        "target", "context", "n", "target_n", "context_n",
        M.conditional_probability(f, t).alias("cond_prob"),
        M.pmi(f, t, c, n).alias("pmi"),
        M.npmi(f, t, c, n).alias("npmi"),
        M.local_mi(f, t, c, n).alias("lmi"),
        M.t_score(f, t, c, n).alias("tscore"),
        M.z_score(f, t, c, n).alias("zscore"),
        M.dice(f, t, c).alias("dice"),
        M.chi_square(f, t, c, n).alias("chisquare"),
        M.log_likelihood(f, t, c, n).alias("loglike"),
        M.affinity(f, t, c).alias("affinity"),
        "entropy_target", "entropy_context",
    )


def assoc_profiles(pair_counts: DataFrame) -> DataFrame:
    """Association profile of each pair: counts, ten measures and two entropies."""
    pairs = shared_once(pair_counts)
    return profile_measures(pair_marginals(pairs), pair_total(pairs))
