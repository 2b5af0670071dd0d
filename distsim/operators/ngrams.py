"""Corpus lines, n-grams and word pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE, clean_line, split_fields, token_windows, tokenize


def corpus_lines(
    documents: DataFrame, text: str = "text", partitions: int | None = None
) -> DataFrame:
    """One row per line of a text column; a carriage return before the break is dropped.

    ``partitions`` deals the documents anew in so many parts first. A file is read in whole row
    groups, so a corpus in fewer of them than there are cores is tokenized by as few tasks;
    corpora of many row groups need no shuffle and leave it out.
    """
    if partitions is not None:
        documents = documents.select(text).repartition(partitions)
    lines = documents.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    return lines.select(
        F.when(F.endswith("line", F.lit("\r")), F.expr("left(line, length(line) - 1)"))
        .otherwise(F.col("line"))
        .alias("line")
    )


def windows(lines: DataFrame, n: int, clean: bool = False, line: str = "line") -> DataFrame:
    """Every window of ``n`` tokens as columns ``w1`` .. ``wn``.

    A line shorter than ``n`` gives one window with nulls at the end.
    """
    if clean:
        lines, line = lines.select(clean_line(line).alias("cleaned")), "cleaned"
    tokens = lines.select(tokenize(line).alias("tokens"))
    return tokens.select(F.explode(token_windows("tokens", n)).alias("w")).select("w.*")


def _joined(n: int, separator: str) -> Column:
    return F.concat_ws(separator, *[F.col(f"w{i + 1}") for i in range(n)]).alias("ngram")


def ngrams(
    lines: DataFrame, n: int = 2, clean: bool = False, full_only: bool = False
) -> DataFrame:
    """n-grams of each line, tokens joined by a space.

    A line shorter than ``n`` gives one short n-gram unless ``full_only``.
    """
    found = windows(lines, n, clean)
    if full_only:
        found = found.where(F.col(f"w{n}").isNotNull())
    return found.select(_joined(n, " "))


def ngram_counts(
    lines: DataFrame,
    n: int = 2,
    clean: bool = False,
    full_only: bool = False,
    lower: bool = False,
) -> DataFrame:
    """Count of each n-gram, tokens joined by a comma.

    Grouping is on the joined text, so uncleaned tokens that contain commas fall
    together when they read the same. ``lower`` lower-cases before counting.
    """
    found = windows(lines, n, clean)
    if full_only:
        found = found.where(F.col(f"w{n}").isNotNull())
    ngram = found.select(_joined(n, ","))
    if lower:
        ngram = ngram.select(F.lower("ngram").alias("ngram"))
    return ngram.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


def trigram_counts(lines: DataFrame, clean: bool = False, lower: bool = True) -> DataFrame:
    """Full trigrams as columns ``w_prev, w, w_next, n``, lower-cased before counting."""
    word = F.lower if lower else F.col
    return (
        windows(lines, 3, clean)
        .where(F.col("w3").isNotNull())
        .groupBy(word("w1").alias("w_prev"), word("w2").alias("w"), word("w3").alias("w_next"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def trigrams_of(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Full trigrams of cleaned lines whose middle, lower-cased, is in the column ``word``.

    The rows of grouped trigrams read from text (``w_prev, w, w_next, n``, lower-cased after
    counting), but the other trigrams are dropped before they are counted and shuffled.
    ``words`` is sent to every task: it is for the neighbors of a list of words.
    """
    middles = F.broadcast(words.select(F.col("word").alias("_middle")).distinct())
    found = windows(lines, 3, clean=True).where(F.col("w3").isNotNull())
    kept = found.join(middles, F.lower("w2") == F.col("_middle"), "left_semi")
    counted = kept.groupBy("w1", "w2", "w3").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        *[F.lower(f"w{i + 1}").alias(c) for i, c in enumerate(("w_prev", "w", "w_next"))], "n")


def word_frequencies(lines: DataFrame, clean: bool = True) -> DataFrame:
    """Frequency list of the corpus: lower-cased tokens and how often each occurs."""
    return (
        windows(lines, 1, clean)
        .where(F.col("w1") != "")
        .groupBy(F.lower("w1").alias("word"))
        .agg(F.count(F.lit(1)).cast("double").alias("freq"))
    )


def parse_pairs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines ``target context`` to columns; any other number of fields is dropped."""
    fields = lines.select(split_fields(line, " ").alias("fields"))
    return fields.where(F.size("fields") == 2).select(
        F.col("fields")[0].alias("target"), F.col("fields")[1].alias("context")
    )


def bigram_pairs(lines: DataFrame, clean: bool = False) -> DataFrame:
    """Adjacent tokens as (target, context).

    Equals ``parse_pairs(ngrams(lines, 2, clean))`` without the detour over text.
    """
    return (
        windows(lines, 2, clean)
        .where(F.col("w2") != "")
        .select(F.col("w1").alias("target"), F.col("w2").alias("context"))
    )


def adjacent_pairs_alnum(lines: DataFrame, line: str = "line") -> DataFrame:
    """Neighbouring tokens stripped to ASCII letters and digits, both non-empty.

    Neighbours are fixed before stripping, so a token of punctuation separates the
    words around it: white space is first made uniform, then the whole line is stripped,
    which leaves such a token as an empty string between two spaces.
    """
    uniform = F.trim(F.regexp_replace(F.col(line), WHITE_SPACE, " "))
    stripped = F.regexp_replace(uniform, "[^A-Za-z0-9 ]+", "")
    tokens = lines.select(F.split(stripped, " ").alias("tokens"))
    return (
        tokens.select(F.explode(token_windows("tokens", 2)).alias("w"))
        .where((F.col("w.w1") != "") & (F.col("w.w2") != ""))
        .select(F.col("w.w1").alias("target"), F.col("w.w2").alias("context"))
    )
