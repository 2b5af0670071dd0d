"""Collapse of cumulative snapshots of conversations before rendering.

A log often holds the same conversation again and again, each time some turns longer. Every
turn gets the hash of all turns up to it: hashes of (position, role, text) combined over a
running frame, in two independent lanes of 64 bits. A conversation whose full hash is among
the turn-prefix hashes of a longer one is a snapshot of that; conversations with equal full
hashes are copies, of which the smallest conv_id stays. Anti-joins keep the maximal
conversations, and only those are rendered.

Turns are laid in ranges by conversation and turn. Frames run within a range and are continued
from the conversation's earlier ranges, so a conversation with a third of all turns is shared by
many tasks; only its rendered text is one value. What many conversations share, such as a first
turn, is aggregated with partial sums before any join, so no join key is hot.

Edges: turns are ordered by turn, role and text, nulls first, so ties and repeated rows have
a place. A null role or text differs from an empty one and renders as empty. Turns without
conv_id belong to no conversation and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LANES = ("h1", "h2")


def _laid(turns: DataFrame) -> DataFrame:
    """Turns in order, stored, with their place ``at`` and the range ``part`` they lie in.

    Ranges are cut by conversation and turn, so a long conversation lies in several.
    """
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))
    return rows.withColumn("part", F.shiftrightunsigned("at", 33))


def _hashed(laid: DataFrame) -> DataFrame:
    """:func:`_laid` with ``k``, ``n`` and the prefix hashes.

    Positions and hashes run within a range; those of a conversation's earlier ranges, one row
    each, are added to them.
    """
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = laid.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    sizes = sizes.select("conv_id", "part",
                         F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("first"),
                         F.sum("size").over(Window.partitionBy("conv_id")).alias("n"))
    here = Window.partitionBy("conv_id", "part").orderBy("at")
    rows = laid.join(sizes, ["conv_id", "part"]).withColumn(
        "k", F.row_number().over(here) + F.col("first")).drop("first")
    rows = rows.withColumns({f"own_{lane}": F.xxhash64(
        F.lit(seed), "k", F.col("role").isNull(), "role", "text")
        for seed, lane in enumerate(LANES)})
    sums = rows.groupBy("conv_id", "part").agg(
        *[F.bit_xor(f"own_{lane}").alias(lane) for lane in LANES])
    sums = sums.select("conv_id", "part", *[
        F.coalesce(F.bit_xor(lane).over(earlier), F.lit(0).cast("long")).alias(f"before_{lane}")
        for lane in LANES])
    frame = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, ["conv_id", "part"])
    return rows.withColumns({lane: F.bit_xor(f"own_{lane}").over(frame).bitwiseXOR(
        F.col(f"before_{lane}")) for lane in LANES})


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Turns with position ``k`` (from 1), size ``n`` of the conversation, and prefix hashes."""
    return _hashed(_laid(turns)).select(
        "conv_id", "turn", "role", "text", "k", *LANES, "n")


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each conversation with what absorbed it, the maximal ones' turns)."""
    laid = _laid(turns)
    hashed = stored(_hashed(laid).select("conv_id", "k", "n", *LANES))
    full = hashed.where("k = n").select("conv_id", "n", *LANES)
    copies = full.groupBy("n", *LANES).agg(F.min("conv_id").alias("first"))
    # The longest conversation with this beginning is maximal, and the smallest id of those
    # has no copy with a smaller one.
    begins = hashed.where("k < n").groupBy(F.col("k").alias("n"), *LANES).agg(
        F.min(F.struct((-F.col("n")).alias("size"), "conv_id")).alias("longest"))
    begins = begins.select("n", *LANES, F.col("longest.conv_id").alias("longer"))
    maximal = copies.join(begins, ["n", *LANES], "left_anti").select(
        F.col("first").alias("conv_id"))
    kept_turns = laid.join(maximal, "conv_id", "left_semi")
    fate = copies.join(begins, ["n", *LANES], "left")
    found = full.join(fate, ["n", *LANES]).select(
        "conv_id", F.col("n").alias("n_turns"),
        F.coalesce("longer", "first").alias("kept_as"))
    return found, kept_turns


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, rendered): the turns in order of ``at`` between start and end marks."""
    def part(name: str):
        # A mark inside a text must not look like one.
        return F.replace(F.coalesce(F.col(name), F.lit("")), F.lit("<|"), F.lit("< |"))

    line = F.concat(F.lit("<|im_start|>"), part("role"), F.lit("\n"), part("text"),
                    F.lit("<|im_end|>\n"))
    rows = turns.select("conv_id", F.struct("at", line.alias("line")).alias("item"))
    items = F.array_sort(F.collect_list("item"))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(items, lambda x: x["line"]), "").alias("rendered"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, kept, kept_as and the rendered text of those that are kept."""
    found, kept = collapse(turns)
    return found.join(render(kept), "conv_id", "left").select(
        "conv_id", "n_turns", (F.col("kept_as") == F.col("conv_id")).alias("kept"), "kept_as",
        "rendered")


# The same from the definitions: prefixes as whole strings, compared as they are.
SQL = r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
prefixes AS (
  SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(to_json([role, text])::VARCHAR, chr(10)) OVER
      (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix
  FROM turns),
whole AS (SELECT conv_id, n, prefix FROM prefixes WHERE k = n),
longer AS (
  SELECT prefix, arg_min(conv_id, (-n, conv_id)) AS longer FROM prefixes WHERE k < n GROUP BY 1),
firsts AS (SELECT prefix, min(conv_id) AS first FROM whole GROUP BY 1),
fate AS (
  SELECT conv_id, n, coalesce(longer, first) AS kept_as
  FROM whole JOIN firsts USING (prefix) LEFT JOIN longer USING (prefix)),
texts AS (
  SELECT conv_id, string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10)
    || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS t
  FROM turns GROUP BY 1)
SELECT conv_id, n AS n_turns, kept_as = conv_id AS kept, kept_as,
  CASE WHEN kept_as = conv_id THEN t END AS rendered
FROM fate JOIN texts USING (conv_id)
"""
