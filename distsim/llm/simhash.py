"""SimHash near-duplicates found with a vantage-point tree.

Fingerprints are 64-bit SimHashes of 3-word shingles; two link if at most ``radius`` bits
differ. Equal fingerprints are merged first, so a group of copies is one point.

A vantage-point tree cuts the Hamming space: a node sends points within distance mu of its
vantage point to one side and the others to the other side. Its top is fitted on a bounded
sample of fingerprints (``sample_rows``), every fingerprint is routed through it, and each
leaf is a shard that one task searches with a tree of its own. The triangle bound decides
which sides a point must visit. Two points within ``radius`` have a midpoint within half
of it of both; the midpoint lies in exactly one leaf, and a point whose ball of half the
radius reaches over a boundary goes to both sides. So every linked pair meets in the leaf
of its midpoint: the search is exact, with far fewer copies than with whole balls.

A task returns a spanning set of links (each point to the smallest linked one), never all
pairs. A shard that the sample shows to be much larger than the others, such as a dense
group of near copies, is split into chunks, and tasks search pairs of chunks.

Edges: null and blank texts have fingerprint 0 and link like any other. Rows with a null
doc_id get a fingerprint but no component. Repeated rows give repeated result rows.

Near copies. ``near_copies`` links texts whose sets of 5-word shingles have a Jaccard
similarity of ``LEAST`` or more. Texts with equal sets are one point. Points get a SimHash of
their set, and the vantage-point tree links those within ``RADIUS`` bits: what it joins is a
bucket of candidates. At a similarity of 0.8 fingerprints differ in ten bits and more, a radius at
which no cut of the Hamming space prunes, so what lies beyond the tree's radius has candidates from
MinHash bands as well: two texts of similarity s share a band with probability
1 - (1 - s^4)^20, which is 0.99997 at 0.8. Candidates of both kinds are checked exactly on their
shingles. The shingles of points in a bucket with others are stored once, and tasks get them by
cell:

* in a first round each bucket's points are held against its smallest one, and in further rounds
  against another one, as long as a round joins a fair part of what is apart. That makes at most
  as many rows as buckets have points, and leaves most buckets with points of one component.
* buckets that still have several are then searched whole. The points outside a bucket's largest
  component, in chunks, meet each other and those inside, in chunks, each pair of chunks in a
  cell; a cell compares what is of different components and returns a spanning set of links.

So all candidate pairs of different components are compared, whatever the size of the bucket, and
no pair of texts is a row. A group of copies that are not similar to each other costs its square
in comparisons, in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored, values
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
SAMPLE_ROWS = 16_384
SHARD_ROWS = 256
MAX_SHARDS = 4096
CHUNK = 1 << 16
BLOCK = 512
COPY_SHINGLE = 5
LEAST = 0.8
BANDS, BAND_ROWS = 20, 4
POINTS = 1024
TURNS = 3
TASK_SHINGLES = 1 << 20


def _fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a text in UTF-8."""
    w = text.lower().split() if text else []
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*[w[k:] for k in range(n)]) if len(w) >= n else [w]
    return _majority(np.array([digest(join(r), SEED) for r in runs], dtype=">u8"))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes (big-endian), as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprint(text: Column) -> Column:
    """SimHash of a text column as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = [_fingerprint(t) for t in values(texts.cast(pa.binary()))]
        return pa.array(found, pa.int64())

    return run(text)


# --- the tree ------------------------------------------------------------------------


def _split(points: np.ndarray, half: int, tries: int = 8):
    """Vantage point and mu that give the smallest larger side, or None if none helps."""
    best = None
    for at in np.linspace(0, len(points) - 1, tries).astype(int):
        d = np.bitwise_count(points ^ points[at])
        upto = np.cumsum(np.bincount(d, minlength=66))
        for mu in range(0, 64):
            left = upto[min(mu + half, 65)]
            right = len(points) - (upto[mu - half] if mu >= half else 0)
            size = max(left, right)
            if best is None or size < best[0]:
                best = (size, points[at], mu)
    return best if best[0] <= 0.75 * len(points) else None


def build_tree(sample: np.ndarray, least: int, half: int, max_leaves: int):
    """(nodes, sizes): nodes are (vantage, mu, left, right), a child below 0 is leaf ~child.

    ``sizes`` are the sample points that reach each leaf.
    """
    nodes, sizes, todo = [], [], [(sample, None, 0)]
    while todo:
        points, parent, side = todo.pop(0)
        cut = None
        if len(points) > least and len(sizes) + len(todo) < max_leaves:
            cut = _split(points, half)
        if cut is None:
            here = ~len(sizes)
            sizes.append(len(points))
        else:
            here = len(nodes)
            nodes.append([cut[1], cut[2], None, None])
            d = np.bitwise_count(points ^ cut[1])
            todo.append((points[d <= cut[2] + half], here, 2))
            todo.append((points[d + half > cut[2]], here, 3))
        if parent is not None:
            nodes[parent][side] = here
    return nodes, sizes


def _route(nodes, points: np.ndarray, half: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions of the points whose balls reach it)."""
    todo = [(0 if nodes else ~0, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node < 0:
            yield ~node, at
            continue
        vantage, mu, left, right = nodes[node]
        d = np.bitwise_count(points[at] ^ vantage).astype(np.int16)
        todo.append((left, at[d <= mu + half]))
        todo.append((right, at[d + half > mu]))


def _links(points: np.ndarray, ids: np.ndarray, radius: int) -> set[tuple[int, int]]:
    """Spanning links (larger id, smaller id) of the points within ``radius``."""
    half, found, todo = (radius + 1) // 2, set(), [np.arange(len(points))]
    while todo:
        at = todo.pop()
        cut = _split(points[at], half) if len(at) > BLOCK else None
        if cut is not None:
            d = np.bitwise_count(points[at] ^ cut[1]).astype(np.int16)
            todo.append(at[d <= cut[2] + half])
            todo.append(at[d + half > cut[2]])
            continue
        at = at[np.argsort(ids[at], kind="stable")]
        p, root = points[at], np.arange(len(at))
        while True:  # the smallest position reachable, in blocks of rows
            new = root.copy()
            for i in range(0, len(at), BLOCK):
                near = np.bitwise_count(p[i:i + BLOCK, None] ^ p[None, :]) <= radius
                new[i:i + BLOCK] = np.where(near, root[None, :], len(at)).min(axis=1)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        far = np.flatnonzero(root != np.arange(len(at)))
        found.update(zip(ids[at[far]].tolist(), ids[at[root[far]]].tolist()))
    return found


def near_links(points: DataFrame, *, radius: int = RADIUS, sample_rows: int = SAMPLE_ROWS,
               shard_rows: int = SHARD_ROWS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Spanning links (a, b) between ids of ``points`` (id, fp) within ``radius`` bits.

    ``points`` should be stored, with distinct fingerprints. The tree's top is fitted on at
    most ``sample_rows`` of them and has at most ``max_shards`` leaves.
    """
    half = (radius + 1) // 2
    n = points.count()
    rows = points.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).select("fp").collect()
    sample = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    share = len(sample) / max(n, 1)
    nodes, sizes = build_tree(sample, max(4, int(shard_rows * share)), half, max_shards)
    usual = max(shard_rows, float(np.median(sizes)) / max(share, 1e-12))
    chunks = [min(1000, int(np.ceil(s / max(share, 1e-12) / (2 * usual)))) or 1 for s in sizes]

    def route(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, at in _route(nodes, fps, half):
                k = chunks[leaf]
                own = (fps[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(k)
                for other in range(k):
                    lo, hi = np.minimum(own, other), np.maximum(own, other)
                    key = (leaf * 1000 + lo.astype(np.int64)) * 1000 + hi.astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), batch.column("id").take(pa.array(at)),
                         batch.column("fp").take(pa.array(at))], ["shard", "id", "fp"])

    def search(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        links = _links(fps, table.column("id").to_numpy(), radius)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    routed = points.select("id", "fp").mapInArrow(route, "shard long, id long, fp long")
    return routed.groupBy("shard").applyInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, sample_rows: int = SAMPLE_ROWS,
                    shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    rows = stored(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    points = stored(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").cast("long").alias("id")))
    links = near_links(points, radius=radius, sample_rows=sample_rows, shard_rows=shard_rows)
    found = components(links).withColumnRenamed("node", "id")
    known = stored(points.join(found, "id", "left").select(
        "fp", F.coalesce("component", "id").alias("component")))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return rows.join(known, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        own.alias("component_id"))


# --- near copies ---------------------------------------------------------------------


def _shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text in UTF-8."""
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    digest, join, n = xxhash.xxh64_intdigest, b" ".join, COPY_SHINGLE
    runs = zip(*[w[k:] for k in range(n)]) if len(w) >= n else [w]
    return np.unique(np.array([digest(join(r), SEED) for r in runs], dtype=np.uint64))


def _sketches(docs: DataFrame) -> DataFrame:
    """(id, digest of the shingle set, its size, its SimHash, MinHash bands) of (id, text)."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
    odd = odd * np.uint64(2) + np.uint64(1)

    def bands(x: np.ndarray) -> list[int]:
        least = np.full(len(odd), np.iinfo(np.uint64).max)
        for at in range(0, len(x), 4096):
            part = (x[at:at + 4096, None] * odd[None, :]).min(axis=0)
            least = np.minimum(least, part)
        rows = least.reshape(BANDS, BAND_ROWS)
        return [xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)]

    def run(batches):
        for batch in batches:
            digests, sizes, fps, found = [], [], [], []
            for text in values(batch.column(1).cast(pa.binary())):
                x = _shingles(text)
                digests.append(xxhash.xxh3_128_digest(x.tobytes(), SEED))
                sizes.append(len(x))
                fps.append(_majority(x.astype(">u8")))
                found.append(np.array(bands(x), np.uint64).view(np.int64))
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(fps, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))],
                ["id", "digest", "size", "fp", "bands"])

    return docs.select("id", "text").mapInArrow(
        run, "id long, digest binary, size long, fp long, bands array<long>")


def _tree_buckets(points: DataFrame) -> DataFrame:
    """(id, size, key) of ``points`` (id, size, fp): the key is that of what the tree joins."""
    distinct = stored(points.groupBy("fp").agg(F.min("id").alias("id")))
    joined = components(near_links(distinct)).withColumnRenamed("node", "id")
    keys = distinct.join(joined, "id", "left").select(
        "fp", F.xxhash64(F.lit("tree"), F.coalesce("component", "id")).alias("key"))
    return points.join(keys, "fp").select("id", "size", "key")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the rows of ``docs`` with these ids, stored."""

    def run(batches):
        for batch in batches:
            texts = values(batch.column("text").cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([_shingles(t).tobytes() for t in texts],
                                              pa.binary())], ["id", "shingles"])

    some = docs.join(small(ids), "id", "left_semi").select("id", "text")
    return stored(some.mapInArrow(run, "id long, shingles binary"))


LEFT, RIGHT, BOTH = 1, 2, 3


def links_in_cell(role: np.ndarray, ids: np.ndarray, component: np.ndarray, sets: list,
                  least: float) -> list[tuple[int, int]]:
    """Links between left and right points of different components that join all they can."""
    root = {int(c): int(c) for c in component}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    right = [k for k in np.flatnonzero(role & RIGHT) if len(sets[k])]
    if not right:
        return []
    sizes = np.array([len(sets[k]) for k in right])
    distinct, at = np.unique(np.concatenate([sets[k] for k in right]), return_inverse=True)
    start = np.cumsum(sizes) - sizes
    links = []
    for k in np.flatnonzero(role & LEFT):
        own = sets[k]
        fit = (np.minimum(sizes, len(own)) >= least * np.maximum(sizes, len(own)))
        fit &= component[right] != component[k]
        if not fit.any():
            continue
        place = np.minimum(np.searchsorted(distinct, own), len(distinct) - 1)
        held = np.zeros(len(distinct), bool)
        held[place[distinct[place] == own]] = True
        both = np.add.reduceat(held[at], start, dtype=np.int64)
        for j in np.flatnonzero(fit & (both >= least * (sizes + len(own) - both))):
            a, b = find(int(component[k])), find(int(component[right[j]]))
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(ids[k]), int(ids[right[j]])))
    return links


def _compared(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b), stored, of the points in each cell.

    ``rows`` has the columns cell, role, id, component and size. Cells are dealt to tasks by
    their hash, so many together as a task can hold the shingles of.
    """
    rows = stored(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(partitions, int(total) // TASK_SHINGLES)

    def search(table: pa.Table) -> pa.Table:
        cell, role, ids, component = (table.column(c).to_numpy() for c in (
            "cell", "role", "id", "component"))
        shingles = table.column("shingles").to_pylist()
        order = np.argsort(cell, kind="stable")
        links = []
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            links += links_in_cell(role[part], ids[part], component[part],
                                   [np.frombuffer(shingles[k], np.uint64) for k in part], least)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = rows.withColumn("part", F.pmod("cell", F.lit(parts))).join(sets, "id")
    return stored(dealt.groupBy("part").applyInArrow(search, "a long, b long"))


def _chunks(n: Column, size: Column, points: int) -> Column:
    """In how many chunks to cut so many points of so many shingles together."""
    return F.greatest(F.ceil(n / points), F.ceil(size / (points * 512)), F.lit(1)).cast("int")


def _star_cells(own: DataFrame, turn: int, points: int) -> DataFrame:
    """Cells of each bucket's center and a chunk of its points of other components.

    ``own`` has key, id, size and component. The center is the smallest point, later another.
    """
    rank = F.col("id") if turn == 0 else F.xxhash64("id", "key", F.lit(turn))
    centers = own.groupBy("key").agg(
        F.min(F.struct(rank.alias("rank"), "id", "component", "size")).alias("c"),
        F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    centers = centers.select("key", *[F.col(f"c.{x}").alias(f"c_{x}") for x in (
        "id", "component", "size")])
    apart = own.join(centers, "key").where("component <> c_component")
    # One center may lead many buckets: each pair once.
    pairs = stored(apart.select("c_id", "c_component", "c_size", "id", "component", "size").distinct())
    counts = pairs.groupBy("c_id").agg(
        _chunks(F.count(F.lit(1)), F.sum("size"), points).alias("chunks"))
    pairs = pairs.join(counts, "c_id").withColumn(
        "cell", F.xxhash64("c_id", F.pmod(F.xxhash64("id"), F.col("chunks"))))
    right = pairs.select("cell", F.lit(RIGHT).alias("role"), "id", "component", "size")
    left = pairs.select("cell", F.lit(LEFT).alias("role"), F.col("c_id").alias("id"),
                        F.col("c_component").alias("component"),
                        F.col("c_size").alias("size")).distinct()
    return right.unionByName(left)


def _whole_cells(own: DataFrame, points: int) -> DataFrame:
    """Cells of all pairs of chunks of a bucket that can hold points of two components."""
    sums = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"),
                                               F.sum("size").alias("size"))
    buckets = sums.groupBy("key").agg(
        F.max(F.struct("n", "component", "size")).alias("most"), F.count(F.lit(1)).alias("of"),
        F.sum("n").alias("n"), F.sum("size").alias("size")).where("of > 1")
    buckets = buckets.select(
        "key", F.col("most.component").alias("major"),
        _chunks(F.col("most.n"), F.col("most.size"), points).alias("inside"),
        _chunks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size"), points)
        .alias("outside"))
    rows = own.join(buckets, "key")
    hashed = F.xxhash64("id", F.lit(7))
    out = rows.where("component <> major").withColumn(
        "i", F.pmod(hashed, F.col("outside")).cast("int"))
    inner = rows.where("component = major").withColumn(
        "i", F.pmod(hashed, F.col("inside")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("j")
    each = out.select("key", "id", "component", "size", "i", every)
    minor = each.select(
        F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("cell"),
        F.when(F.col("i") == F.col("j"), BOTH).when(F.col("i") < F.col("j"), LEFT)
        .otherwise(RIGHT).alias("role"), "id", "component", "size")
    every = F.explode(F.sequence(F.lit(0), F.col("inside") - 1)).alias("j")
    left = out.select("key", "id", "component", "size", "i", every).select(
        F.xxhash64("key", "i", F.lit("major"), "j").alias("cell"), F.lit(LEFT).alias("role"),
        "id", "component", "size")
    every = F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("j")
    right = inner.select("key", "id", "component", "size", "i", every).select(
        F.xxhash64("key", "j", F.lit("major"), "i").alias("cell"), F.lit(RIGHT).alias("role"),
        "id", "component", "size")
    return minor.unionByName(left).unionByName(right)


def near_copies(docs: DataFrame, *, least: float = LEAST, points: int = POINTS,
                turns: int = TURNS) -> DataFrame:
    """(id, component) of every row of ``docs`` (id, text); component is the smallest id.

    ``docs`` should be stored, with distinct ids. ``points`` is the size of a chunk, ``turns``
    the most rounds of centers.
    """
    sketches = stored(_sketches(docs))
    distinct = stored(sketches.groupBy("digest").agg(
        F.min(F.struct("id", "size", "fp", "bands")).alias("p")))
    members = distinct.select("p.id", "p.size", F.explode("p.bands").alias("key")).unionByName(
        _tree_buckets(distinct.select("p.id", "p.size", "p.fp")))
    shared = members.groupBy("key").count().where("count > 1").select("key")
    members = stored(members.join(shared, "key", "left_semi"))
    sets = _sets(docs, members.select("id").distinct())

    def apart(links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(components found, members with theirs)"""
        found = stored(components(links)) if links is not None else docs.sparkSession.createDataFrame(
            [], "node long, component long")
        own = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
            "component", F.coalesce("component", "id"))
        return found, stored(own)

    links, turn = None, 0
    found, own = apart(None)
    while turn < turns:
        cells = _star_cells(own, turn, points)
        new = _compared(cells, sets, least)
        links = new if links is None else links.unionByName(new)
        found, own = apart(links)
        turn += 1
        # Go on while a round joins a fair part of the points in buckets.
        if new.count() * 20 < sets.count():
            break
    rest = _compared(_whole_cells(own, points), sets, least)
    found = components(rest if links is None else links.unionByName(rest))
    known = distinct.select("digest", F.col("p.id").alias("point")).join(
        found.withColumnRenamed("node", "point"), "point", "left").select(
        "digest", F.coalesce("component", "point").alias("component"))
    return sketches.select("id", "digest").join(stored(known), "digest").select(
        "id", "component")
