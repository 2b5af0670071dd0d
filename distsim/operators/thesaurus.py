"""Thesaurus lookup and context-aware ranking of substitutes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_fields
from .containment import words_in


def top_rows(df: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """First ``n`` rows per group by descending score, ties by neighbor.

    Spark limits each group before the shuffle, so a large group costs at most ``n``
    rows per input task.
    """
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col("neighbor"))
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def _words(words: str | Sequence[str]) -> list[str]:
    return [words] if isinstance(words, str) else list(words)


def reduced_thesaurus(
    thesaurus: DataFrame, words: str | Sequence[str] | DataFrame | None = None, size: int = 50
) -> DataFrame:
    """The ``size`` nearest neighbors of the given words (of every word if none).

    ``thesaurus`` has columns target1, target2, cosine or target, neighbor, cosine.
    ``words`` may be a DataFrame with a column ``target``. Cosines are rounded to six
    decimals before ranking, the precision of a stored thesaurus.
    """
    if "target1" in thesaurus.columns:
        thesaurus = thesaurus.withColumnsRenamed({"target1": "target", "target2": "neighbor"})
    # Nulls are dropped first: else each use of the result pushes its own test for them
    # below the ranking, and what computes the thesaurus runs once per use.
    rows = thesaurus.select("target", "neighbor", F.bround("cosine", 6).alias("cosine")).where(
        F.col("target").isNotNull() & F.col("neighbor").isNotNull() & F.col("cosine").isNotNull()
    )
    if isinstance(words, DataFrame):
        rows = rows.join(words.select("target").distinct(), "target", "left_semi")
    elif words is not None:
        rows = rows.where(F.col("target").isin(_words(words)))
    return top_rows(rows, "target", "cosine", size)


def shared_neighbors(reduced: DataFrame) -> DataFrame:
    """A reduced thesaurus behind a shuffle that all uses of it in a plan share.

    All columns are keys, so a use that needs fewer of them still reads the same shuffle.
    """
    return reduced.repartition("neighbor", "target", "cosine")


def neighbor_frequencies(
    reduced: DataFrame, frequencies: DataFrame, sort: bool = False
) -> DataFrame:
    """Neighbors with their corpus frequency; neighbors without one are dropped.

    ``sort`` orders the rows inside each partition by descending frequency.
    """
    rows = reduced.join(frequencies, reduced["neighbor"] == frequencies["word"]).select(
        "target", "neighbor", "cosine", "freq"
    )
    return rows.sortWithinPartitions(F.col("freq").desc()) if sort else rows


def sentence_contexts(
    sentences: DataFrame,
    words: str | Sequence[str] | DataFrame,
    strict_context: bool = False,
    sentence: str = "sentence",
) -> DataFrame:
    """Left and right neighbor of a word's first occurrence in each sentence with it.

    A sentence that has the word first, or only inside another word, gives the empty
    context. ``strict_context`` gives the right neighbor of a first word and drops
    sentences where the word is no token. ``word`` is the key, as given; the other
    columns are lower-cased.

    ``words`` may be a DataFrame with a column ``target``, of any size. With
    ``strict_context`` tokens are joined with it; else words are looked up in sentences by
    their rarest runs of characters (:func:`~distsim.operators.containment.words_in`). A list
    tries every word on every sentence, which is for a few words.
    """
    tokens = split_fields(sentence, " ")
    if strict_context:
        rows = sentences.select(tokens.alias("tokens"))

        def around(token: Column, at: Column) -> Column:
            return F.when(
                F.array_position("tokens", token) == at + 1,
                F.struct(
                    token.alias("word"),
                    F.when(at > 0, F.get("tokens", at - 1)).alias("w_prev"),
                    F.get("tokens", at + 1).alias("w_next"),
                ),
            )

        if isinstance(words, DataFrame):
            chosen = words.select(F.col("target").alias("word")).distinct()
            first = F.explode(F.array_compact(F.transform("tokens", around)))
            hits = rows.select(first.alias("hit")).select("hit.*").join(chosen, "word")
        else:
            listed = F.array(*[F.lit(w) for w in _words(words)])
            first = F.explode(F.array_compact(F.transform(
                "tokens", lambda t, at: F.when(F.array_contains(listed, t), around(t, at)))))
            hits = rows.select(first.alias("hit")).select("hit.*")
        left, right = F.col("w_prev"), F.col("w_next")
    else:
        word = F.col("word")
        if isinstance(words, DataFrame):
            held = words_in(sentences, words, sentence)
        else:
            held = sentences.select(
                F.col(sentence).alias("sentence"),
                F.explode(F.array(*[F.lit(w) for w in _words(words)])).alias("word"),
            ).where(F.contains("sentence", word))
        found = held.select("word", split_fields("sentence", " ").alias("tokens"))
        hits = found.withColumn("at", F.array_position("tokens", word).cast("int"))
        left, right = (
            F.when(F.col("at") > 1, F.get("tokens", F.col("at") - 1 + k)) for k in (-1, 1)
        )
    return hits.select(
        "word",
        F.lower(F.coalesce(left, F.lit(""))).alias("w_prev"),
        F.lower("word").alias("target"),
        F.lower(F.coalesce(right, F.lit(""))).alias("w_next"),
    )


def context_trigrams(
    trigrams: DataFrame, contexts: DataFrame, reduced: DataFrame, same_sentence: bool = False
) -> DataFrame:
    """Trigrams whose middle is a neighbor and whose sides occur around the word.

    Left and right side may come from different sentences unless ``same_sentence``.
    ``weight`` counts the (left, right) sentence combinations that match; contexts are
    aggregated before the joins, so repeated contexts do not multiply rows. The
    neighbor join comes first: it is the selective one, and its table holds a bounded
    number of rows per word.
    """
    neighbors = reduced.select("target", F.col("neighbor").alias("w"))
    rows = trigrams.join(neighbors, "w")
    keyed = contexts.select(F.col("word").alias("target"), "w_prev", "w_next")
    if same_sentence:
        both = keyed.groupBy("target", "w_prev", "w_next").agg(F.count(F.lit(1)).alias("weight"))
        rows = rows.join(both, ["target", "w_prev", "w_next"])
    else:
        left = keyed.groupBy("target", "w_prev").agg(F.count(F.lit(1)).alias("_left"))
        right = keyed.groupBy("target", "w_next").agg(F.count(F.lit(1)).alias("_right"))
        rows = (
            rows.join(left, ["target", "w_prev"])
            .join(right, ["target", "w_next"])
            .withColumn("weight", F.col("_left") * F.col("_right"))
        )
    return rows.select("target", "w_prev", "w", "w_next", "n", "weight")


def substitute_score(cosine: Column, freq: Column, n: Column) -> Column:
    """``cosine [+ ln(n + 1)] + ln(freq) / 10``; the bonus applies when ``n`` is known."""
    log_freq = (
        F.when(freq > 0, F.ln(freq))
        .when(freq == 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )
    base = F.when(n.isNull(), cosine).otherwise(cosine + F.ln(n + 1))
    return base + log_freq / 10


def score_neighbors(
    neighbors: DataFrame, matches: DataFrame, synonyms: int = 10, dedupe: bool = False
) -> DataFrame:
    """Score neighbors with frequencies against matching trigrams and keep the best.

    Each matching trigram scores its neighbor separately, as often as its weight says,
    so a neighbor can take several places. ``dedupe`` keeps the best score of each.

    The score rises with ``n``, so of the trigrams of one neighbor the ``synonyms`` with the
    largest ``n`` are enough; the others are dropped before the join, which is dealt by both
    words, whatever the session's settings.
    """
    both = ["target", "neighbor"]
    matched = matches.select("target", F.col("w").alias("neighbor"), "n", "weight")
    matched = matched.groupBy(*both, "n").agg(F.sum("weight").alias("weight"))
    best = Window.partitionBy(*both).orderBy(F.col("n").desc())
    matched = matched.repartition(*both).withColumn("_k", F.row_number().over(best)).where(
        F.col("_k") <= synonyms).drop("_k")
    scored = neighbors.repartition(*both).join(matched, ["target", "neighbor"], "left").select(
        "target",
        "neighbor",
        substitute_score(F.col("cosine"), F.col("freq"), F.col("n")).alias("score"),
        F.coalesce("weight", F.lit(1)).alias("weight"),
    )
    if dedupe:
        scored = scored.groupBy("target", "neighbor").agg(F.max("score").alias("score"))
    else:
        # A row of weight w stands for w equal rows; more than ``synonyms`` copies
        # cannot reach the result.
        copies = F.sequence(F.lit(1), F.least(F.col("weight"), F.lit(synonyms)).cast("int"))
        scored = scored.select("target", "neighbor", "score", F.explode(copies)).drop("col")
    return top_rows(scored, "target", "score", synonyms).select("target", "neighbor", "score")
