"""Pairwise distributional similarity of targets.

A target's vector is its rows of ``pair_counts`` (target, context, n). Every measure is
computed from sums over the contexts two targets share plus totals of each target, so
vectors never have to be gathered into one row:

* cosine, Lin and weighted Jaccard need the dot product and the sum of both weights;
* L1 = s1 + s2 - 2 * sum min(v1, v2) and L2^2 = q1 + q2 - 2 * dot, where s and q are the
  sum and the sum of squares of a vector;
* for the divergences, a context that only one target has contributes a term that
  depends on its own weight alone, so the total of those terms over the whole vector,
  less the shared part, gives the unshared part.

The matrix of target pairs is cut into cells. Targets fall into ``blocks`` blocks by
hash; a vector entry goes to every cell of its block's row and column; one cell is
joined on context. Three things follow:

* a frequent context costs every cell the same share, and a frequent target is spread
  over ``blocks`` cells, so no key is hot;
* all shared contexts of a pair meet in one cell, so the rows of pairs, by far the
  largest table of the job, are summed and filtered where they arise and never
  shuffled: only the entries are, ``blocks + 1`` times;
* the number of tasks is fixed by ``partitions``. Adaptive coalescing would go by the
  bytes of the entries, which say little about the pairs they make.

Under a high cosine threshold most pairs that share only frequent contexts fall away.
The pruned plan (prefix filtering after Bayardo, Ma and Srikant, "Scaling Up All Pairs
Similarity Search", WWW 2007) then never forms them: see :func:`_pruned_sums`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from . import packed as packs
from .counts import shared_once

MEASURES = ["cosine", "wjaccard", "lin", "l1", "l2", "jsd", "randomic", "askew1", "askew2"]

# Cells per partition: enough for an even load, few enough to keep copies of entries low.
CELLS_PER_PARTITION = 8

# Slack for rounding when a bound is compared with the threshold.
SLACK = 1 - 1e-9


def _grid(
    spark: SparkSession, partitions: int | None, blocks: int | None
) -> tuple[int, int]:
    """Number of join partitions, and of blocks so that their pairs fill them evenly."""
    if partitions is None:
        partitions = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if blocks is None:
        blocks = math.ceil(math.sqrt(2 * CELLS_PER_PARTITION * partitions))
    return partitions, blocks


def configure(spark: SparkSession) -> None:
    """Let joins and aggregations use a partitioning by some of their keys.

    Both sides of the pair join are partitioned by cell. With Spark's default, they are
    shuffled again by cell and context, and the rows of pairs, the largest table of the
    job, by target. An application that computes similarities calls this once for its
    session; it changes no result, and no operator calls it. The setting holds for all
    queries of the session: a join on two keys whose sides happen to be partitioned by one
    of them is then not shuffled again.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def target_vectors(pair_counts: DataFrame) -> DataFrame:
    """Size, sum and sum of squares of each target's vector."""
    return pair_counts.groupBy("target").agg(
        F.count(F.lit(1)).alias("contexts"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("n")).alias("sumsq"),
    )


def vector_parts(pair_counts: DataFrame, size: int = 500) -> DataFrame:
    """Vectors as maps: each target in parts of about ``size`` contexts.

    A frequent target has more contexts than one row should hold, so its contexts are
    dealt over ``ceil(contexts / size)`` parts by a hash any engine can repeat.
    """
    parts = (
        pair_counts.groupBy("target")
        .agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    )
    digest = F.conv(F.left(F.md5("context"), F.lit(8)), 16, 10).cast("bigint")
    return (
        pair_counts.join(parts, "target")
        .withColumn("part", F.pmod(digest, F.col("parts")))
        .groupBy("target", "part")
        .agg(F.map_from_entries(F.collect_list(F.struct("context", "n"))).alias("vector"))
    )


def association_filter(pair_counts: DataFrame, assoc_min: float | None) -> DataFrame:
    """Keep pairs counted more than ``assoc_min`` times."""
    rows = pair_counts.select("target", "context", "n")
    return rows if assoc_min is None else rows.where(F.col("n") > assoc_min)


def _half(v: Column, jsd: str) -> Column:
    """Half a weight: integer division by default, the real half with ``jsd='real'``."""
    if jsd not in ("integer", "real"):
        raise ValueError(f"jsd must be 'integer' or 'real', got {jsd!r}")
    return F.floor(v / 2) if jsd == "integer" else v / F.lit(2.0)


def _own_divergence(jsd: str) -> Column:
    """Divergence of one entry from half of itself, for contexts only one target has."""
    return M.relative_entropy(F.col("n"), _half(F.col("n"), jsd))


def _totals(entries: DataFrame, distances: bool, jsd: str, *more: Column) -> DataFrame:
    """Sum, sum of squares and divergence from its own half of each target's vector."""
    aggregates = [F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")]
    if distances:
        aggregates.append(F.sum(_own_divergence(jsd)).alias("own"))
    return entries.groupBy("target").agg(*aggregates, *more)


def _in_cells(rows: DataFrame, blocks: int, partitions: int, part: str) -> DataFrame:
    """Copies of the rows in the cells (i, j), i <= j, of their target's block.

    ``part`` chooses the cells of the block's row, of its column, or both.
    """
    # Never null, said so that no test for it is pushed below the shuffle of the entries.
    block = F.coalesce(F.pmod(F.hash("target"), F.lit(blocks)), F.lit(0))
    first, last = {
        "row": (F.col("block"), F.lit(blocks - 1)),
        "column": (F.lit(0), F.col("block")),
        "both": (F.lit(0), F.lit(blocks - 1)),
    }[part]
    copies = rows.withColumn("block", block).withColumn("_k", F.explode(F.sequence(first, last)))
    keyed = copies.withColumns(
        {"i": F.least("block", "_k"), "j": F.greatest("block", "_k")}
    ).drop("block", "_k")
    return keyed.repartition(partitions, "i", "j")


def _entry_keys(rows: DataFrame) -> list[str]:
    """What two entries must share to meet: the context, and whether they are added ones."""
    return [c for c in ("context", "added") if c in rows.columns]


def _join_cells(rows: DataFrame, partitions: int, blocks: int) -> DataFrame:
    """Pairs of entries on a shared context, each pair of targets in one cell (i, j)."""

    def side(name: str, part: str) -> DataFrame:
        kept = {c: f"{name}_{c}" for c in rows.columns if c not in _entry_keys(rows)}
        return _in_cells(rows, blocks, partitions, part).withColumnsRenamed(kept)

    keys = ["i", "j", *_entry_keys(rows)]
    return side("a", "row").join(side("b", "column").hint("merge"), keys).where((F.col("i") != F.col("j")) | (F.col("a_target") < F.col("b_target")))


def _contributions(v1: Column, v2: Column, distances: bool, jsd: str) -> dict[str, Column]:
    """What one shared context adds to each sum of a pair."""
    terms = {"dot": v1 * v2, "shared": v1 + v2}
    if distances:
        mean = _half(v1 + v2, jsd)
        terms["least"] = F.least(v1, v2)
        terms["skew1"] = M.relative_entropy(v1, v2) - v1 * F.lit(M.LN_ABSENT)
        terms["skew2"] = M.relative_entropy(v2, v1) - v2 * F.lit(M.LN_ABSENT)
        terms["js"] = (
            M.relative_entropy(v1, mean)
            + M.relative_entropy(v2, mean)
            - M.relative_entropy(v1, _half(v1, jsd))
            - v2 * F.lit(M.LN_HALF)
        )
    return terms


def _pair_rows(cells: DataFrame, distances: bool, extra: dict[str, Column] | None = None):
    """(rows of pairs, names of what is constant in a pair), ``target1 < target2``.

    A row has both weights of one shared context. What depends on the pair alone travels with
    it: the product of the norms, the totals, and the ``extra`` columns.
    """
    ordered = F.col("a_target") < F.col("b_target")

    def oriented(first: str, second: str) -> Column:
        return F.when(ordered, F.col(first)).otherwise(F.col(second))

    constants = {
        "norm": F.col("a_root") * F.col("b_root"),
        "total": F.col("a_s") + F.col("b_s"),
        **(extra or {}),
    }
    v1, v2 = F.col("a_n"), F.col("b_n")
    if distances:
        v1, v2 = oriented("a_n", "b_n"), oriented("b_n", "a_n")
        constants["squares"] = F.col("a_q") + F.col("b_q")
        constants["s1"] = oriented("a_s", "b_s")
        constants["own1"] = oriented("a_own", "b_own")
    rows = cells.select(
        "i", "j",
        F.least("a_target", "b_target").alias("target1"),
        F.greatest("a_target", "b_target").alias("target2"),
        v1.alias("v1"), v2.alias("v2"),
        *[value.alias(name) for name, value in constants.items()],
    )
    return rows, list(constants)


def _summed(rows: DataFrame, constants: list[str], distances: bool, jsd: str) -> DataFrame:
    """Sums over the shared contexts of each pair."""
    terms = _contributions(F.col("v1"), F.col("v2"), distances, jsd)
    return rows.groupBy("i", "j", "target1", "target2").agg(
        *[F.sum(term).alias(name) for name, term in terms.items()],
        *[F.max(name).alias(name) for name in constants],
    )


def _pair_sums(
    cells: DataFrame, distances: bool, jsd: str, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Sums over shared contexts for each pair of targets, ``target1 < target2``."""
    rows, constants = _pair_rows(cells, distances, extra)
    return _summed(rows, constants, distances, jsd)


def _with_totals(
    entries: DataFrame, distances: bool, jsd: str, all_pairs: bool
) -> DataFrame:
    """Entries with the totals of their target, and the root of its sum of squares."""
    totals = _totals(entries, distances, jsd)
    rows = entries.join(totals, "target")
    if all_pairs:
        # One more entry per target, of weight zero and apart from all contexts: it pairs
        # all targets and adds nothing to any sum.
        zero = totals.withColumns(
            {"context": F.lit(""), "n": F.lit(0).cast("bigint"), "added": F.lit(True)}
        )
        rows = rows.withColumn("added", F.lit(False)).unionByName(zero)
    return rows.withColumn("root", F.sqrt("q"))


def _plain_sums(
    entries: DataFrame, distances: bool, jsd: str, all_pairs: bool, partitions: int, blocks: int
) -> DataFrame:
    """Sums of every pair that shares a context, or of every pair at all."""
    rows = _with_totals(entries, distances, jsd, all_pairs)
    return _pair_sums(_join_cells(rows, partitions, blocks), distances, jsd)


def _framed(entries: DataFrame, distances: bool, jsd: str) -> DataFrame:
    """Entries with the totals of their target and ``df``, the targets that have the context.

    All branches of a plan read one shuffle of the entries: the context is said to be never
    null, so that no test for it is pushed below, and all columns are used.
    """
    keyed = entries.withColumn("context", F.coalesce("context", F.lit("")))
    frequency = keyed.groupBy("context").agg(F.count("n").alias("df"))
    return _with_totals(keyed, distances, jsd, False).join(frequency, "context")


def _block(target: str, blocks: int) -> Column:
    return F.coalesce(F.pmod(F.hash(target), F.lit(blocks)), F.lit(0))


def _hybrid_sums(
    entries: DataFrame, distances: bool, jsd: str, rare: int, partitions: int, blocks: int
) -> DataFrame:
    """Sums of every pair that shares a context; each kind of context by the cheaper way.

    A context that ``d`` targets have makes ``d * (d - 1) / 2`` rows of pairs, and in cells
    ``d * (blocks + 1)`` copies of entries. Contexts of at most ``rare`` targets are joined as
    they are, without a copy of any entry, and their rows of pairs are sent to the cell of the
    pair; the others are copied to the cells and joined there. A cell sums both, so pairs on
    frequent contexts, the large part, are still not shuffled.
    """
    rows = _framed(entries, distances, jsd)
    few, many = F.col("df") <= rare, F.col("df") > rare
    joined = _join_cells(rows.where(many).drop("df"), partitions, blocks)
    frequent, constants = _pair_rows(joined, distances)

    def side(name: str) -> DataFrame:
        kept = {c: f"{name}_{c}" for c in rows.columns if c not in ("context", "df")}
        return rows.where(few & (F.col("df") > 1)).drop("df").withColumnsRenamed(kept)

    met = side("a").join(side("b"), "context").where(F.col("a_target") < F.col("b_target"))
    a, b = _block("a_target", blocks), _block("b_target", blocks)
    met = met.withColumns({"i": F.least(a, b), "j": F.greatest(a, b)})
    scarce = _pair_rows(met, distances)[0].repartition(partitions, "i", "j")
    return _summed(frequent.unionByName(scarce), constants, distances, jsd)


def _side(name: str, df: DataFrame) -> DataFrame:
    """Columns renamed for one side of a join, but for what both sides share."""
    kept = {c: f"{name}_{c}" for c in df.columns if c not in ("salt", *_entry_keys(df))}
    return df.withColumnsRenamed(kept)


def _word_sums(
    entries: DataFrame, distances: bool, jsd: str, all_pairs: bool, words: DataFrame
) -> DataFrame:
    """Sums of the pairs with at least one of the words.

    The words' entries meet all entries on context, so no pair of others is formed and no
    entry is copied. A pair of two words is taken from the smaller one.
    """
    rows = _with_totals(entries, distances, jsd, all_pairs)
    chosen = words.select("target").where(F.col("target").isNotNull()).distinct()
    marked = rows.join(chosen.withColumn("word", F.lit(True)), "target", "left")
    one = _side("a", rows.join(chosen, "target", "left_semi"))
    met = one.join(_side("b", marked), _entry_keys(rows)).where(_taken_once())
    return _pair_sums(met.withColumns({"i": F.lit(0), "j": F.lit(0)}), distances, jsd)


def _taken_once() -> Column:
    """Pairs of a word and another target, those of two words from the smaller one."""
    return (F.col("a_target") != F.col("b_target")) & (
        F.col("b_word").isNull() | (F.col("a_target") < F.col("b_target")))


def _salted_word_sums(
    entries: DataFrame, distances: bool, jsd: str, words: DataFrame, split: int
) -> DataFrame:
    """:func:`_word_sums` with the entries of frequent contexts split.

    A context that more than ``split`` targets have is dealt in ``ceil(df / split)`` parts by
    target, and the words' entries on it are copied to each part, so no task gets more than
    about ``split`` entries of a context for each word that has it.
    """
    rows = _framed(entries, distances, jsd)
    rows = rows.withColumn("parts", F.ceil(F.col("df") / split).cast("int")).drop("df")
    chosen = words.select("target").where(F.col("target").isNotNull()).distinct()
    marked = rows.join(chosen.withColumn("word", F.lit(True)), "target", "left").withColumn(
        "salt", F.pmod(F.hash("target"), F.col("parts"))).drop("parts")
    one = rows.join(chosen, "target", "left_semi").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = _side("a", one).join(_side("b", marked), ["context", "salt"]).where(_taken_once())
    return _pair_sums(met.withColumns({"i": F.lit(0), "j": F.lit(0)}), distances, jsd)


def _word_cell_sums(
    entries: DataFrame, distances: bool, jsd: str, words: DataFrame, partitions: int, blocks: int
) -> DataFrame:
    """:func:`_word_sums` in cells, for so many words that their pairs are most of all pairs."""
    rows = _with_totals(entries, distances, jsd, False)
    chosen = words.select("target").where(F.col("target").isNotNull()).distinct()
    marked = rows.join(chosen.withColumn("word", F.lit(True)), "target", "left")
    cells = _join_cells(marked, partitions, blocks)
    return _pair_sums(cells.where("a_word OR b_word"), distances, jsd)


def _levelled(entries: DataFrame, distances: bool, jsd: str, sim_min: float) -> DataFrame:
    """Entries with the totals of their target and the frequency level of their context.

    Levels rise with the number of targets a context has, two levels for each doubling.
    ``cut`` is the highest level down to which, from the top, the vector's norm reaches
    ``sim_min`` of the whole; ``rest`` is the share of the norm above it, which is less
    than ``sim_min``. Sums per level keep this a window over a few dozen rows per target.
    """
    rows, totals = _levels(entries, distances, jsd, sim_min)
    return rows.join(totals.drop("size"), "target").withColumn("root", F.sqrt("q"))


def _levels(
    entries: DataFrame, distances: bool, jsd: str, sim_min: float
) -> tuple[DataFrame, DataFrame]:
    """Entries with the level of their context, and the totals, cut and rest of targets."""
    frequency = entries.groupBy("context").agg(F.count("n").alias("df"))
    rows = entries.join(
        frequency.select("context", F.floor(2 * F.log2("df")).cast("int").alias("level")),
        "context",
    )
    aggregates = [F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")]
    if distances:
        aggregates.append(F.sum(_own_divergence(jsd)).alias("own"))
    by_target = Window.partitionBy("target")
    from_top = by_target.orderBy(F.col("level").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    levels = rows.groupBy("target", "level").agg(
        *aggregates, F.count(F.lit(1)).alias("size")
    ).withColumns({"reached": F.sum("q").over(from_top), "all": F.sum("q").over(by_target)})
    enough = F.col("reached") >= F.lit(sim_min * sim_min * SLACK) * F.col("all")
    totals = levels.groupBy("target").agg(
        *[F.sum(c).alias(c) for c in ("s", "q", "own") if c in levels.columns],
        F.sum("size").alias("size"),
        F.max(F.when(enough, F.col("level"))).alias("cut"),
        F.sqrt(
            F.coalesce(F.max(F.when(~enough, F.col("reached"))), F.lit(0)) / F.max("all")
        ).alias("rest"),
    )
    return rows, totals


def _pruned_sums(
    entries: DataFrame, distances: bool, jsd: str, sim_min: float, partitions: int, blocks: int
) -> DataFrame:
    """Sums of every pair that can reach the cosine ``sim_min``; exact for those.

    Only entries at or below the cut of their target are joined. Take a pair and the
    lower of its two cuts: above it, one of the two vectors has less than ``sim_min`` of
    its norm, so a pair that reaches the threshold also shares a context below, where
    both have their entries joined. For the pairs found, that bound on the missing part
    drops most; the others get the missing contexts from the vector that lacks them, by
    lookups within the cell.
    """
    rows = _levelled(entries, distances, jsd, sim_min)
    joined = _join_cells(rows.where(F.col("level") <= F.col("cut")), partitions, blocks)
    a_cut, b_cut, a_rest, b_rest = (F.col(c) for c in ("a_cut", "b_cut", "a_rest", "b_rest"))
    bound = (
        F.when(a_cut < b_cut, a_rest).when(a_cut > b_cut, b_rest).otherwise(a_rest * b_rest)
    )
    a_first = F.col("a_target") < F.col("b_target")
    lacks_first = F.when(a_first, a_cut <= b_cut).otherwise(b_cut < a_cut)
    found = _pair_sums(joined, distances, jsd, {"bound": bound, "lacks_first": lacks_first})
    reach = F.col("dot") + F.col("bound") * F.col("norm")
    found = found.where(reach >= F.lit(sim_min * SLACK) * F.col("norm"))

    # Missing contexts of the vector with the lower cut, then their weight in the other.
    missing = rows.where(F.col("level") > F.col("cut")).select("target", "context", "n")
    missing = _in_cells(missing, blocks, partitions, "both").withColumnsRenamed(
        {"target": "lacking", "n": "n_lacking"}
    )
    other = _in_cells(entries, blocks, partitions, "both").withColumnsRenamed(
        {"target": "other", "n": "n_other"}
    )

    first = F.col("lacks_first")
    one, two = F.col("target1"), F.col("target2")
    found = found.withColumns(
        {
            "lacking": F.when(F.col("bound") > 0, F.when(first, one).otherwise(two)),
            "other": F.when(first, two).otherwise(one),
        }
    )
    rest = found.join(missing.hint("merge"), ["i", "j", "lacking"], "left").join(
        other.hint("merge"), ["i", "j", "other", "context"], "left"
    )
    v1 = F.when(first, F.col("n_lacking")).otherwise(F.col("n_other"))
    v2 = F.when(first, F.col("n_other")).otherwise(F.col("n_lacking"))
    terms = _contributions(F.col("v1"), F.col("v2"), distances, jsd)
    known = [c for c in found.columns if c not in ("i", "j", "target1", "target2", *terms)]
    known = [c for c in known if c not in ("bound", "lacks_first", "lacking", "other")]
    shared = F.col("n_other").isNotNull()
    return (
        rest.select(
            "i", "j", "target1", "target2", *terms, *known,
            F.when(shared, v1).otherwise(0).alias("v1"), F.when(shared, v2).otherwise(0).alias("v2"),
        )
        .groupBy("i", "j", "target1", "target2")
        .agg(
            *[(F.max(name) + F.sum(term)).alias(name) for name, term in terms.items()],
            *[F.max(name).alias(name) for name in known],
        )
    )


def packed_totals(
    entries: DataFrame, distances: bool, jsd: str, words: DataFrame | None = None
) -> DataFrame:
    """Totals of each target's vector as doubles, its size, and whether it is a word."""
    totals = _doubles(_totals(entries, distances, jsd, F.count(F.lit(1)).alias("size")))
    if words is None:
        return totals
    chosen = words.select("target").distinct().withColumn("word", F.lit(1.0))
    return totals.join(chosen, "target", "left").fillna(0.0, ["word"])


def _doubles(totals: DataFrame) -> DataFrame:
    return totals.select("target", "size", *[
        F.col(c).cast("double").alias(c) for c in totals.columns if c not in ("target", "size")])


def _packed_sums(
    entries: DataFrame, distances: bool, jsd: str, sim_min: float, words: DataFrame | None,
    partitions: int | None, blocks: int | None, packed: bool | str = True,
    rare: int | str | None = None,
) -> DataFrame:
    """Sums of every pair that reaches the cosine, by :mod:`~distsim.operators.packed`.

    No entry is copied to cells, so ``rare`` says only that the hybrid plan is meant. Pruned,
    entries above the cut of their target are not multiplied (:func:`_pruned_sums` says why none
    is missed).
    """
    default = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = packs.grid(partitions, blocks, default)
    if packed == "hybrid":
        rare = blocks if rare in (None, "auto") else int(rare)
    if packed in ("pruned", "hybrid"):
        # Said to be never null, so that all branches of the plan read one shuffle of the entries.
        entries = entries.withColumns(
            {c: F.coalesce(c, F.lit("")) for c in ("target", "context")})
    if packed == "pruned":
        entries, totals = _levels(entries, distances, jsd, sim_min)
        totals = _doubles(totals)
    else:
        totals = packed_totals(entries, distances, jsd, words)
    return packs.packed_sums(
        entries, totals, distances, jsd, sim_min, blocks, rare)


def _uniform(seed: int) -> Column:
    """A number in [0, 1) per pair from a digest that any engine repeats."""
    digest = F.md5(F.concat_ws("\t", F.lit(str(seed)), "target1", "target2"))
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("bigint") * F.lit(2.0**-52)


def _finish(
    sums: DataFrame,
    distances: bool,
    sim_min: float | None,
    dist_max: float | None,
    seed: int,
) -> DataFrame:
    """Measures from sums and totals, then the thresholds."""
    shared, total = F.col("shared"), F.col("total")
    rows = sums.withColumn("cosine", M.ratio(F.col("dot"), F.col("norm")))
    if sim_min is not None:
        rows = rows.where(F.col("cosine") >= sim_min)
    if distances:
        s1, s2 = F.col("s1"), total - F.col("s1")
        l1 = (total - 2 * F.col("least")).cast("double")
        l2 = F.sqrt(F.col("squares") - 2 * F.col("dot"))
        skew1 = F.col("skew1") + s1 * F.lit(M.LN_ABSENT)
        skew2 = F.col("skew2") + s2 * F.lit(M.LN_ABSENT)
        jsd = F.col("js") + F.col("own1") + s2 * F.lit(M.LN_HALF)
    else:
        l1 = l2 = skew1 = skew2 = jsd = F.lit(0.0)
    rows = rows.select(
        "target1", "target2", "cosine",
        M.weighted_jaccard(shared, total).alias("wjaccard"),
        M.ratio(shared, total).alias("lin"),
        l1.alias("l1"), l2.alias("l2"), jsd.alias("jsd"),
        _uniform(seed).alias("randomic"),
        skew1.alias("askew1"), skew2.alias("askew2"),
    )
    if dist_max is not None:
        far = (F.col("lin") > dist_max) & (F.col("l1") > dist_max) & (F.col("jsd") > dist_max)
        rows = rows.where(~far)
    return rows


def similarity(
    pair_counts: DataFrame,
    sim_min: float | None = None,
    dist_max: float | None = None,
    assoc_min: float | None = None,
    distances: bool = False,
    jsd: str = "integer",
    seed: int = 0,
    partitions: int | None = None,
    blocks: int | None = None,
    prune: bool = False,
    all_pairs: bool = False,
    words: str | Sequence[str] | DataFrame | None = None,
    rare: int | str | None = None,
    words_plan: str = "join",
    split: int = 4096,
    packed: bool | str = False,
) -> DataFrame:
    """Similarity of pairs of targets, ``target1 < target2``.

    ``pair_counts`` has one row per (target, context), as the operator of that name
    gives. ``sim_min`` keeps pairs with at least that cosine. ``dist_max`` drops pairs
    whose Lin, L1 and divergence all exceed it. ``assoc_min`` keeps only vector entries
    counted more often. Without ``distances``, L1, L2 and the divergences are zero.

    With a positive ``sim_min`` only targets that share a context are ever paired.
    ``all_pairs=True`` gives every pair of targets, shared context or not, which is
    quadratic in the number of targets; without either, the call is refused.

    ``words`` (a word, a list, or a DataFrame with a column ``target``) keeps the pairs with
    at least one of them. ``words_plan`` says how: ``"join"`` meets the words' entries with all
    entries on context and forms no other pairs; ``"salted"`` does so with contexts of more than
    ``split`` targets dealt in parts, for vocabularies with very frequent contexts; ``"cells"``
    uses the cells, for tables that hold a large part of all targets.

    ``rare`` uses the hybrid plan, with the same result: contexts that at most so many targets
    have are joined as they are, without copies of entries, and only the others in cells.
    ``"auto"`` takes the number from which on copies are the cheaper way, ``2 * blocks + 3``.
    It pays where partitions are many, since copies in cells grow with their square root.

    ``packed`` multiplies packed vectors with numpy in each cell (see
    :mod:`~distsim.operators.packed`), with the same result: rows of pairs are never rows of a
    DataFrame. It is the plan for many targets, with or without ``words``; ``partitions`` then
    defaults to ``spark.sql.shuffle.partitions``, and ``blocks`` to two cells per partition.
    ``packed="pruned"`` multiplies only the entries that the pruned plan joins, and looks the
    others up in the cell. ``packed="hybrid"`` leaves entries on contexts of a single target out
    before vectors are packed. Entries are packed once whatever ``rare`` is, and a cell drops those
    on contexts that its other block lacks, so no number of targets decides on copies there.

    ``partitions`` defaults to four times ``spark.sql.shuffle.partitions``. Entries are
    copied ``blocks + 1`` times; ``blocks`` defaults to about eight cells per partition, and
    may be set lower if partitions are many for other reasons than the size of the data.
    ``prune`` uses the pruned plan, with the same result; it pays at high thresholds over
    long vectors. Call :func:`configure` once per session for the best plan.
    """
    if all_pairs == (sim_min is not None and sim_min > 0):
        raise ValueError("give either a positive sim_min or all_pairs=True")
    if prune and (all_pairs or words is not None):
        raise ValueError("pruning needs a positive sim_min and no words")
    if rare is not None and (all_pairs or prune or words is not None):
        raise ValueError("the hybrid plan needs a positive sim_min, no pruning and no words")
    if words_plan not in ("join", "salted", "cells"):
        raise ValueError(f"words_plan must be 'join', 'salted' or 'cells', got {words_plan!r}")
    if words_plan != "join" and (all_pairs or words is None):
        raise ValueError("a plan for words needs words and a positive sim_min")
    if packed not in (True, False, "pruned", "hybrid"):
        raise ValueError(f"packed must be a boolean, 'pruned' or 'hybrid', got {packed!r}")
    if packed and (all_pairs or prune or words_plan != "join"
                   or rare is not None and packed != "hybrid"):
        raise ValueError("the packed plan needs a positive sim_min and no other plan")
    if packed in ("pruned", "hybrid") and words is not None:
        raise ValueError("the pruned and the hybrid plan take no words")
    entries = shared_once(association_filter(pair_counts, assoc_min))
    if packed:
        chosen = None if words is None else word_table(entries, words)
        sums = _packed_sums(
            entries, distances, jsd, sim_min, chosen, partitions, blocks, packed, rare)
        return _finish(sums, distances, sim_min, dist_max, seed)
    partitions, blocks = _grid(pair_counts.sparkSession, partitions, blocks)
    if words is not None:
        chosen = word_table(entries, words)
        if words_plan == "join":
            sums = _word_sums(entries, distances, jsd, all_pairs, chosen)
        elif words_plan == "salted":
            sums = _salted_word_sums(entries, distances, jsd, chosen, split)
        else:
            sums = _word_cell_sums(entries, distances, jsd, chosen, partitions, blocks)
    else:
        if rare is not None:
            limit = 2 * blocks + 3 if rare == "auto" else int(rare)
            sums = _hybrid_sums(entries, distances, jsd, limit, partitions, blocks)
        elif prune:
            sums = _pruned_sums(entries, distances, jsd, sim_min, partitions, blocks)
        else:
            sums = _plain_sums(entries, distances, jsd, all_pairs, partitions, blocks)
    return _finish(sums, distances, sim_min, dist_max, seed)


def word_table(df: DataFrame, words: str | Sequence[str] | DataFrame) -> DataFrame:
    """Words as a DataFrame with a column ``target``."""
    if isinstance(words, DataFrame):
        return words.select("target")
    listed = [words] if isinstance(words, str) else list(words)
    return df.sparkSession.createDataFrame([(w,) for w in listed], "target string")


def thesaurus(similarity: DataFrame, swap_askew: bool = False) -> DataFrame:
    """Every pair in both directions, with the same measures.

    ``swap_askew`` exchanges the two skew divergences in the reversed row, which the
    stored layout does not.
    """
    if not swap_askew:
        sides = F.array(
            F.struct(F.col("target1").alias("a"), F.col("target2").alias("b")),
            F.struct(F.col("target2").alias("a"), F.col("target1").alias("b")),
        )
        rows = similarity.select(F.explode(sides).alias("pair"), *MEASURES)
        return rows.select(
            F.col("pair.a").alias("target1"), F.col("pair.b").alias("target2"), *MEASURES
        )
    fields = ["target1", "target2", "askew1", "askew2"]
    swapped = ["target2", "target1", "askew2", "askew1"]
    sides = F.array(
        F.struct(*fields), F.struct(*[F.col(s).alias(f) for s, f in zip(swapped, fields)])
    )
    rest = [m for m in MEASURES if not m.startswith("askew")]
    rows = similarity.select(F.explode(sides).alias("pair"), *rest).select("pair.*", *rest)
    return rows.select("target1", "target2", *MEASURES)
