"""Sentences with a word replaced by its neighbors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_fields
from .containment import hashed_sentences, words_in, words_with
from .thesaurus import reduced_thesaurus

# Fixed value: the characters that count as part of a word at a word boundary.
WORD_CHARACTER = r"[\p{L}\p{Nd}_]"


def _neighbor_list(thesaurus: DataFrame, word: str, size: int) -> Column:
    """The best ``size`` neighbors of one word as an array, from a scalar subquery.

    At most ``size`` short strings, whatever the thesaurus holds.
    """
    best = reduced_thesaurus(thesaurus, word, size)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "neighbor")))
    return best.agg(ranked.getField("neighbor").alias("neighbors")).scalar()


def boundary_pattern(word: str) -> str:
    """Regular expression for ``word`` with a word boundary before it, none after.

    Letters of any script count as word characters, on every Java version.
    """
    head = re.match(r"[^\W]", word)
    before = f"(?<!{WORD_CHARACTER})" if head else f"(?<={WORD_CHARACTER})"
    return before + r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def sentence_variants(
    sentences: DataFrame,
    thesaurus: DataFrame,
    word: str,
    size: int = 50,
    sentence: str = "sentence",
) -> DataFrame:
    """Each sentence that contains ``word``, as it is and once per neighbor.

    Only the boundary before the word is checked: ``find`` also matches in ``finding``.
    The row with a null ``neighbor`` is the original.
    """
    options = F.concat(
        F.array(F.lit(None).cast("string")),
        F.coalesce(_neighbor_list(thesaurus, word, size), F.array().cast("array<string>")),
    )
    rows = sentences.where(F.contains(sentence, F.lit(word))).select(
        F.col(sentence).alias("sentence"), F.explode(options).alias("neighbor")
    )
    literal = F.replace(F.replace("neighbor", F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    changed = F.regexp_replace("sentence", F.lit(boundary_pattern(word)), literal)
    return rows.select(
        "sentence", "neighbor", F.coalesce(changed, F.col("sentence")).alias("variant")
    )


def _quoted(replacement: Column) -> Column:
    """A replacement text without special characters."""
    return F.replace(F.replace(replacement, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def sentence_variants_of_words(
    sentences: DataFrame,
    thesaurus: DataFrame,
    words: DataFrame,
    size: int = 50,
    sentence: str = "sentence",
) -> DataFrame:
    """:func:`sentence_variants` for a table of words (column ``target``) of any size.

    One row per sentence, word in it and neighbor, with the word in ``target``; the row with a
    null ``neighbor`` is the original. A sentence with several of the words has rows for each.
    """
    best = reduced_thesaurus(thesaurus, words, size).select("target", "neighbor")
    held = words_in(sentences, words, sentence).withColumnRenamed("word", "target")
    word = F.col("target")
    head = F.when(F.rlike(word, F.lit(r"^[\p{L}\p{Nd}_]")), F.lit(f"(?<!{WORD_CHARACTER})"))
    before = head.otherwise(F.lit(f"(?<={WORD_CHARACTER})"))
    end = F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    pattern = F.concat(before, F.lit(r"\Q"), end, F.lit(r"\E"))
    changed = held.join(best, "target").select(
        "sentence", "target", "neighbor",
        F.regexp_replace("sentence", pattern, _quoted(F.col("neighbor"))).alias("variant"))
    originals = held.select(
        "sentence", "target", F.lit(None).cast("string").alias("neighbor"),
        F.col("sentence").alias("variant"))
    return originals.unionByName(changed)


def substitute_sentence(
    sentences: DataFrame,
    thesaurus: DataFrame,
    word: str,
    k: int = 1,
    sentence: str = "sentence",
) -> DataFrame:
    """Replace every occurrence of ``word`` by its ``k`` best neighbors, one row each.

    A sentence without the word passes unchanged, once per neighbor; a word without
    neighbors gives no rows.
    """
    rows = sentences.select(
        F.col(sentence).alias("sentence"),
        F.explode(_neighbor_list(thesaurus, word, k)).alias("neighbor"),
    )
    return rows.select(
        "sentence", "neighbor", F.replace("sentence", F.lit(word), F.col("neighbor")).alias("variant")
    )


def substitute_words(
    sentences: DataFrame,
    thesaurus: DataFrame,
    words: DataFrame | None = None,
    k: int = 1,
    sentence: str = "sentence",
    inside: bool = False,
) -> DataFrame:
    """:func:`substitute_sentence` for a table of words (column ``target``), or for all.

    One row per sentence, word that is a token of it, and neighbor. Tokens are joined with
    the words' neighbors, so the thesaurus is ranked once for all words, and sentences
    without any of the words give no rows. A token travels with a hash of its sentence, and the
    text, which a long sentence would repeat for each token, joins last. With ``inside``, as for a single word, the word
    may stand anywhere in the sentence, within other words as well.
    """
    best = reduced_thesaurus(thesaurus, words, k).select("target", "neighbor")
    lists = best.groupBy(F.col("target").alias("word")).agg(
        F.collect_list("neighbor").alias("neighbors"))
    if inside:
        rows = words_with(sentences, best, sentence, lists)
    else:
        hashed = hashed_sentences(sentences, sentence)
        tokens = F.explode(F.array_distinct(split_fields("sentence", " "))).alias("word")
        held = hashed.select("hash", tokens).where("word <> ''").distinct().join(lists, "word")
        # A token has no blank; one of another sentence with the same hash is not found.
        padded = [F.concat(F.lit(" "), F.col(c), F.lit(" ")) for c in ("sentence", "word")]
        rows = hashed.hint("merge").join(held, "hash").where(F.contains(*padded))
    return rows.select(
        "sentence", F.col("word").alias("target"), F.explode("neighbors").alias("neighbor")
    ).withColumn("variant", F.replace("sentence", F.col("target"), F.col("neighbor")))
