"""Association and similarity measures as plain column arithmetic.

Association measures take ``f`` (pair count), ``t`` (target total), ``c`` (context
total) and ``n`` (grand total). Similarity measures take sums over the contexts two
targets share, together with the totals of each target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smoothing weights of the skew divergence.
ALPHA = 0.99
BETA = 0.01

# relative_entropy(v, 0) = v * LN_ABSENT and relative_entropy(v, v / 2) = v * LN_HALF.
LN_ABSENT = math.log(1 / BETA)
LN_HALF = math.log(1 / (ALPHA / 2 + BETA))


def expected(row_total: Column, column_total: Column, n: Column) -> Column:
    """Expected cell count under independence."""
    return row_total * column_total / n


def conditional_probability(f: Column, t: Column) -> Column:
    return f / t


def pmi(f: Column, t: Column, c: Column, n: Column) -> Column:
    return F.ln(f) - F.ln(expected(t, c, n))


def npmi(f: Column, t: Column, c: Column, n: Column) -> Column:
    """PMI over ``-ln(f / n)``; NaN when one pair makes up the whole table."""
    bound = F.ln(n) - F.ln(f)
    return F.when(bound != 0, pmi(f, t, c, n) / bound).otherwise(F.lit(float("nan")))


def local_mi(f: Column, t: Column, c: Column, n: Column) -> Column:
    return f * pmi(f, t, c, n)


def t_score(f: Column, t: Column, c: Column, n: Column) -> Column:
    return (f - expected(t, c, n)) / F.sqrt(f)


def z_score(f: Column, t: Column, c: Column, n: Column) -> Column:
    e = expected(t, c, n)
    return (f - e) / F.sqrt(e)


def dice(f: Column, t: Column, c: Column) -> Column:
    return F.lit(2.0) * f / (t + c)


def affinity(f: Column, t: Column, c: Column) -> Column:
    """Mean of the two conditional probabilities."""
    return F.lit(0.5) * (f / t + f / c)


def contingency_cells(f: Column, t: Column, c: Column, n: Column) -> list[tuple[Column, Column]]:
    """(observed, expected) for the four cells of the 2x2 table."""
    return [
        (f, expected(t, c, n)),
        (t - f, expected(t, n - c, n)),
        (c - f, expected(n - t, c, n)),
        (n - t - c + f, expected(n - t, n - c, n)),
    ]


def _sum_cells(cells: list[tuple[Column, Column]], term) -> Column:
    total = None
    for observed, exp in cells:
        cell = F.when(exp != 0, term(observed, exp)).otherwise(F.lit(0.0))
        total = cell if total is None else total + cell
    return total


def chi_square(f: Column, t: Column, c: Column, n: Column) -> Column:
    """Pearson chi-square; cells with no expectation are skipped."""
    return _sum_cells(contingency_cells(f, t, c, n), lambda o, e: (o - e) * (o - e) / e)


def log_likelihood(f: Column, t: Column, c: Column, n: Column) -> Column:
    """Dunning's G2; cells with no expectation or no observation are skipped."""

    def term(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.ln(o / e)).otherwise(F.lit(0.0))

    return F.lit(2.0) * _sum_cells(contingency_cells(f, t, c, n), term)


def entropy_aggregate(n: Column) -> Column:
    """Aggregate: ``-sum p ln p`` of the counts ``n``, from one pass over the group.

    With total T this is ``ln T - sum(n ln n) / T``. Rounding noise below zero, for a
    group of one, is clipped.
    """
    n = n.cast("double")
    total = F.sum(n)
    return F.greatest(F.ln(total) - F.sum(n * F.ln(n)) / total, F.lit(0.0))


def relative_entropy(p: Column, q: Column) -> Column:
    """``p ln(p / (0.99 q + 0.01 p))``, zero for ``p = 0``."""
    p = p.cast("double")
    smoothed = F.lit(ALPHA) * q + F.lit(BETA) * p
    return F.when(p == 0, F.lit(0.0)).otherwise(p * F.ln(p / smoothed))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, zero for an empty whole.

    Gives the cosine from dot product and norms, and Lin's measure from the summed
    weights over the shared contexts and over all contexts.
    """
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def weighted_jaccard(shared: Column, total: Column) -> Column:
    """Half the summed weights over the shared contexts, over the rest of the total."""
    half = shared / F.lit(2.0)
    return ratio(half, total - half)
