"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a share of all words by its weight, at most ``max_epochs`` times its own
size; what a capped source cannot take is shared again among the others by weight. The
closed form of that is target = min(cap, level * weight), and the level is found in a few
rounds of one aggregate each.

Within a source, each document draws an exponential key -ln(u) / quality (Efraimidis and
Spirakis, "Weighted random sampling with a reservoir", 2006), u from a hash of its id and
text, so reruns agree. Complete epochs come first: floor(target / size) copies of every
document. The rest of the target is filled in key order up to the document that brings the
sum nearest to it; documents are never cut.

A source may hold a third of all rows, so it is never sorted whole. Keys fall into
``buckets`` ranges; sums per source and range find the one range in which the budget ends,
and only that range is sorted. What results is a small table with one row per source,
and whether a document is taken follows from its own key and that row: the documents are
not shuffled.

Edges: a null text has size 0 and takes 0; null sources are one source, last in order.
Repeated rows (same id and text) share a key and are one row of the order with a count; at the
end of the budget as many of them are taken as it has room for. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import has_rows, numbered, set_aside, small, stored, word_count

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 4096
SEED = 20_240


def quality_weight(text: Column, size: Column) -> Column:
    """Quality in (0, 1]: falls with the number of markup and filler symbols per word."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0))
    return 1.0 / (1.0 + 4.0 * symbols / F.greatest(size, F.lit(1)))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with __size, __quality and __key."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 11)
    u = (draw + 0.5) / float(1 << 53)
    sized = docs.withColumn("__size", word_count(F.col("text")))
    sized = sized.withColumn("__quality", quality_weight(F.col("text"), F.col("__size")))
    return sized.withColumn("__key", -F.log(u) / F.col("__quality"))


def _bucket(buckets: int) -> Column:
    """Range of the key; scaled by the source's mean quality, the ranges fill evenly."""
    part = F.floor((1.0 - F.exp(-F.col("__key") * F.col("scale"))) * buckets)
    return F.least(part, F.lit(buckets - 1)).cast("int")


def _targets(sources: DataFrame, weights, max_epochs: int) -> DataFrame:
    """``sources`` (source, source_size, scale) with target, epochs and rest."""
    n = len(weights)
    ranked = numbered(sources, F.col("source").asc_nulls_last())
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("number") % n + 1).cast("int"))
    ranked = stored(ranked.select("source", "source_size", "scale", choice.alias("weight"),
                                  (F.col("source_size") * float(max_epochs)).alias("cap")))
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("cap")
        row = ranked.agg(
            F.sum("source_size").alias("total"), F.count(F.when(over, 1)).alias("capped"),
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("used"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if row.capped == capped or not row.free:
            break
        level, capped = (row.total - row.used) / row.free, row.capped
    target = F.least("cap", F.col("weight") * level)
    size = F.greatest("source_size", F.lit(1))
    epochs = F.floor(target / size).cast("int")
    return ranked.select("source", "source_size", "scale", target.alias("target"),
                         epochs.alias("epochs"),
                         (target - epochs * F.col("source_size")).alias("rest"))


def mixture(docs: DataFrame, *, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
            buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per source: its size, target, epochs, and where the fractional epoch ends.

    ``docs`` has doc_id, text and source. The result is stored.
    """
    keyed = stored(_keyed(docs.select("doc_id", "text", "source"), seed).select(
        "doc_id", "source", "__size", "__quality", "__key"))
    sources = keyed.groupBy("source").agg(
        F.sum("__size").alias("source_size"), F.avg("__quality").alias("scale"))
    targets = stored(_targets(sources, weights, max_epochs))
    placed = _join(keyed, targets.select("source", "scale", "rest")).withColumn(
        "__bucket", _bucket(buckets))
    sums = placed.groupBy("source", "__bucket", "rest").agg(F.sum("__size").alias("words"))
    upto = Window.partitionBy("source").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("upto", F.sum("words").over(upto)).where("upto >= rest")
    ends = ends.groupBy("source").agg(F.min(F.struct(
        "__bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    ends = stored(ends.select("source", F.col("end.__bucket").alias("last"),
                              F.col("end.before").alias("before")))
    inside = _join(placed, ends, "inner").where(F.col("__bucket") == F.col("last"))
    # Repeated rows are one row of the order, with a count.
    inside = inside.groupBy("source", "__key", "doc_id", "__size", "before", "rest").agg(
        F.count(F.lit(1)).alias("rows"))
    order = ["__key", F.col("doc_id").asc_nulls_first()]
    words = F.col("rows") * F.col("__size")
    running = F.sum(words).over(Window.partitionBy("source").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    # Taking a document must not move the sum further from the target than it was.
    room = (F.col("rest") - running + words) / F.greatest("__size", F.lit(1)) + F.lit(0.5)
    take = F.least("rows", F.floor(F.when(F.col("__size") > 0, room).otherwise(
        F.when(running <= F.col("rest"), F.col("rows")).otherwise(0))))
    taken = inside.withColumn("take", take).where("take > 0")
    cuts = taken.groupBy("source").agg(F.max(F.struct(
        "__key", "doc_id", "take", "rows")).alias("cut"))
    return stored(_join(_join(targets, ends, "left"), cuts, "left").select(
        "source", "source_size", "scale", "target", "epochs", "last",
        F.col("cut.__key").alias("cut_key"), F.col("cut.doc_id").alias("cut_id"),
        F.col("cut.take").alias("cut_take"), F.col("cut.rows").alias("cut_rows")))


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null matching null; the right side is broadcast if counted small."""
    other = right.withColumnRenamed("source", "__source")
    return left.join(small(other), F.col("source").eqNullSafe(F.col("__source")), how).drop(
        "__source")


def with_copies(docs: DataFrame, plan: DataFrame, *, buckets: int = BUCKETS, seed: int = SEED
                ) -> DataFrame:
    """``docs`` with __size, __copies, __source_size and __target, by the plan's rows.

    If only some of the repeated rows at a cut are taken, those are the first by partition.
    """
    table = plan.select(F.col("source").alias("__source"), F.struct(
        "scale", "epochs", "last", "cut_key", "cut_id", "cut_take", "cut_rows", "source_size",
        "target").alias("__plan"))
    keyed = _keyed(docs, seed)
    joined = keyed.join(small(table), F.col("source").eqNullSafe(F.col("__source")), "left")
    p, key = F.col("__plan"), F.col("__key")
    part = F.least(F.floor((1.0 - F.exp(-key * p["scale"])) * buckets), F.lit(buckets - 1))
    before = (key < p["cut_key"]) | ((key == p["cut_key"]) & F.coalesce(
        F.col("doc_id") < p["cut_id"], F.col("doc_id").isNull() & p["cut_id"].isNotNull()))
    at = (part == p["last"]) & (key == p["cut_key"]) & F.col("doc_id").eqNullSafe(p["cut_id"])
    joined = joined.withColumn("__at", F.coalesce(at, F.lit(False)))
    whole = F.lit(True)
    if has_rows(plan.where("cut_take < cut_rows")):
        joined, number = _numbered_at_cut(joined)
        whole = number < p["cut_take"]
    more = (part < p["last"]) | ((part == p["last"]) & F.coalesce(before, F.lit(False)))
    more = more | (F.col("__at") & whole)
    copies = p["epochs"] + F.coalesce(more, F.lit(False)).cast("int")
    return joined.withColumn("__copies", copies).withColumn(
        "__source_size", p["source_size"]).withColumn("__target", p["target"]).drop(
        "__source", "__plan", "__quality", "__key", "__at", "__id", "__number", "__first")


def _numbered_at_cut(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The rows, stored, and the number from 0 of each row at the cut of its source.

    Rows are numbered within the partitions they lie in; no partition sees those of another.
    """
    rows = stored(rows.withColumn("__id", F.monotonically_increasing_id()))
    tied = rows.where("__at").select("source", "__id", F.shiftrightunsigned("__id", 33).alias("p"))
    own = Window.partitionBy("source", "p").orderBy("__id")
    numbers = tied.withColumn("n", F.row_number().over(own) - 1)
    earlier = Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    firsts = tied.groupBy("source", "p").count().withColumn(
        "first", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    firsts = firsts.select(F.col("source").alias("s"), F.col("p").alias("q"), "first")
    numbers = numbers.join(small(firsts), F.col("source").eqNullSafe(F.col("s"))
                           & (F.col("p") == F.col("q")))
    numbers = numbers.select("__id", (F.col("n") + F.col("first")).alias("__number"))
    return rows.join(numbers, "__id", "left"), F.coalesce("__number", F.lit(0))


def mix(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of every row of ``docs`` (doc_id, text, source)."""
    rows = docs.select("doc_id", "text", "source")
    own = {k: v for k, v in options.items() if k in ("buckets", "seed")}
    taken = with_copies(rows, mixture(rows, **options), **own)
    return taken.select(
        "doc_id", "source", F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__copies").alias("copies"),
        (F.col("__copies") * F.col("__size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns."""
    rows, restored = set_aside(docs, "doc_id", "text", "source")
    own = {k: v for k, v in options.items() if k in ("buckets", "seed")}
    taken = with_copies(rows, mixture(rows, **options), **own)
    return restored(taken.where("__copies > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))))
