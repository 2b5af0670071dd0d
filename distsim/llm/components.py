"""Connected components of a link table by contraction to the smallest neighbor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_rows, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node.

    Each round points every node at its smallest neighbor, jumps once to that node's own
    choice, and replaces both ends of each link by the result; links within one node
    vanish. A node that is the smallest of its component always keeps itself, so the last
    one left is the smallest. Links shrink in every round; each round's tables are stored,
    which cuts the lineage. Only whether links are left comes to the driver. A node with
    very many links is a skewed join key, which adaptive execution splits, and its smallest
    neighbor is a minimum with partial aggregation.

    Null ends and self links are ignored; an empty table gives an empty result.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = stored(ends.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    result = None
    while has_rows(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("to"))
        first = stored(first)
        second = first.select(F.col("node").alias("to"), F.col("to").alias("parent"))
        moved = stored(first.join(second, "to").select("node", "parent"))
        for end in ("a", "b"):
            map_ = moved.select(F.col("node").alias(end), F.col("parent").alias(f"{end}2"))
            edges = edges.join(map_, end)
        edges = stored(edges.where("a2 <> b2").select(
            F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        if result is None:
            result = moved.select("node", F.col("parent").alias("component"))
        else:
            later = moved.select(F.col("node").alias("component"), "parent")
            result = stored(result.join(later, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")))
    if result is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    return result
