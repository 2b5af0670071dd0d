"""Quality rules: hashed n-gram log-likelihood ratio after a few base rules.

Two multinomials over hashed word n-grams are estimated: one from trusted documents, one
from the whole raw corpus. A document's verdict is its log-likelihood ratio divided by its
number of n-grams, against a fixed threshold (after the hashed n-gram importance weights of
Xie et al., "Data Selection for Language Models via Importance Resampling", 2023).

Only built-in column functions are used. Counting is one aggregation into ``buckets`` rows
with partial sums in every task. The table of ``buckets`` logarithms is the only thing that
passes through the driver, and its size is the parameter; it goes back into the plan as a
constant array, so scoring is one pass over the documents without any shuffle.

Edges: a null or blank text has no words, fails the base rules and scores 0. Rows are
judged one by one, so repeated rows get the same verdict. With no trusted document at all
the ratio is 0 everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, words

BUCKETS = 1 << 14
ORDERS = (1, 2)
PRIOR = 16.0
THRESHOLD = -0.07
TRUSTED_ROWS = 20_000
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _from(h: Column, k: int) -> Column:
    """The elements of ``h`` from position ``k`` on, padded with nulls when zipped."""
    return F.slice(h, F.lit(k + 1), F.greatest(F.size(h), F.lit(k + 1)))


def _hashes(w: Column) -> Column:
    """A 64-bit hash of each word; all n-grams are hashed from these."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _grams(h: Column, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` words, from the hashes of the words."""
    if n == 1:
        return h
    runs = F.arrays_zip(*[_from(h, k).alias(f"w{k}") for k in range(n)])
    full = F.slice(runs, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))
    return F.transform(full, lambda run: F.xxhash64(run))


def _covered(hashes: Column, n: int) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def from_sorted(s: Column) -> Column:
        def twice(e, k):
            return (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])

        marked = F.transform(s, lambda e, k: F.when(
            F.coalesce(twice(e, k), (e["h"] == F.get(s, k - 1)["h"]),
                       (e["h"] == F.get(s, k + 1)["h"]), F.lit(False)), e["i"]))
        starts = F.sort_array(F.array_compact(marked))
        # Each window adds the words that lie past the end of the one before.
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + n).alias("end"),
                                  (a["n"] + i + n - F.greatest(a["end"], i)).alias("n")),
            lambda a: a["n"])

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(pairs, from_sorted)
                  ).otherwise(F.lit(0))


def _buckets(h: Column, n: int, buckets: int) -> Column:
    """Bucket numbers of the n-grams of one order; ``buckets`` is a power of two."""
    return F.transform(_grams(h, n), lambda g: g.bitwiseAND(F.lit(buckets - 1)).cast("int"))


def base_rules(text: Column, w: Column, h: Column) -> dict[str, Column]:
    """Counts behind the base rules; ``w`` has the words of ``text``, ``h`` their hashes."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0))
        .cast("long"),
        "n_dup_lines": F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0))
        .cast("long"),
        "n_repeat_words": _covered(_grams(h, WINDOW), WINDOW).cast("long"),
    }


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of at most ``rows`` documents labelled as good, spread by a hash of the id."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def ratio_table(docs: DataFrame, trusted: DataFrame, *, orders=ORDERS, buckets: int = BUCKETS,
                prior: float = PRIOR) -> list[float]:
    """Log ratio of trusted to raw probability of each bucket, over all of ``docs``.

    Trusted counts are shrunk towards those expected at the raw rate by ``prior``
    pseudo-counts, so a bucket that is too rare to tell has a ratio near zero.

    ``trusted`` has the ids (``doc_id``) of trusted documents; its size is bounded by
    :func:`trusted_ids`, so it is broadcast.
    """
    flagged = docs.select("doc_id", _hashes(words(F.col("text"))).alias("h")).join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    grams = [_buckets(F.col("h"), n, buckets) for n in orders]
    rows = flagged.select("good", F.explode(F.concat(*grams)).alias("b"))
    rows = rows.groupBy("b").agg(F.count("*").alias("raw"), F.count("good").alias("good"))
    counts = {r.b: (r.raw, r.good) for r in rows.toLocalIterator()}
    raw = sum(x for x, _ in counts.values())
    good = sum(x for _, x in counts.values())
    if not good:
        return [0.0] * buckets
    rate = good / raw
    pairs = (counts.get(b, (0, 0)) for b in range(buckets))
    return [round(math.log((g + prior) / (r * rate + prior)), 4) for r, g in pairs]


def with_quality(docs: DataFrame, table: list[float], *, threshold: float = THRESHOLD,
                 orders=ORDERS) -> DataFrame:
    """``docs`` (with column ``text``) plus a struct column ``quality_rules``.

    Its fields are the base counts, ``base_failed``, ``ratio`` (per n-gram) and ``kept``.
    """
    numbers = F.split(F.lit(",".join(f"{x:g}" for x in table)), ",").cast("array<double>")
    split, hashed, counts = free_names(docs, "words", "hashes", "counts")
    text, w, h = F.col("text"), F.col(split), F.col(hashed)
    base = base_rules(text, w, h)
    sums = [F.aggregate(_buckets(h, n, len(table)), F.lit(0.0),
                        lambda a, g: a + F.get(numbers, g)) for n in orders]
    counted = docs.withColumn(split, words(text)).withColumn(hashed, _hashes(w))
    counted = counted.withColumn(counts, F.struct(
        *[c.alias(k) for k, c in base.items()], sum(sums).alias("total")))
    n, b = F.col(f"{counts}.n_words"), F.col(counts)
    grams_n = sum(F.greatest(n - (k - 1), F.lit(0)) for k in orders)
    ratio = F.when(n > 0, F.round(b["total"] / grams_n, 6)).otherwise(F.lit(0.0))
    failed = (n < MIN_WORDS) | (100 * b["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    fields = [b[k].alias(k) for k in base]
    # Exploding one element keeps a filter on the result from being moved below, where the
    # words would be split anew for each use.
    verdict = F.struct(*fields, failed.alias("base_failed"), ratio.alias("ratio"),
                       (~failed & (ratio >= threshold)).alias("kept"))
    return counted.withColumn("quality_rules", F.explode(F.array(verdict))).drop(
        split, hashed, counts)


def quality_rules(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD,
                  buckets: int = BUCKETS, orders=ORDERS, trusted_rows: int = TRUSTED_ROWS
                  ) -> DataFrame:
    """Verdict on every row of ``docs`` (doc_id, text), learned from ``labels``."""
    rows = docs.select("doc_id", "text")
    table = ratio_table(rows, trusted_ids(labels, trusted_rows), orders=orders, buckets=buckets)
    judged = with_quality(rows, table, threshold=threshold, orders=orders)
    return judged.select("doc_id", "quality_rules.*")
