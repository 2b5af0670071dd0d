"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors x, y have cosine >= c exactly if |x - y|^2 <= 2 - 2c. All vectors are rotated
by a fixed random rotation and split into ``blocks`` blocks of coordinates. If the whole
squared distance is within the budget, at least one block is within its share, budget *
(its coordinates / all coordinates). So the pairs that pass a block's range join form a
superset of the links, and each is then checked by its full cosine in double precision.
The search is exact.

Equal vectors are merged first, with a count. The rest is ordered by the nearest of some
pivots (fitted on a bounded sample), so that near vectors are neighbors, and cut into groups
of at most ``group_rows``. In each block a group has a bounding box; two groups are joined
only if in some block their boxes come within the block's radius. Each joined pair of groups
is one task, which compares in blocks of rows. A hot group of near copies is many groups, so
many tasks. Tasks return counts of links and a spanning set of them, never pairs: each pair
of vectors is counted where its groups meet, which is one task.

What the driver holds is one box per group.

Edges: null and zero vectors, and vectors with null or non-finite components, link with
nothing; so do vectors of different length. Rows with a null vec_id are left out of the
links and have no component. Repeated rows with the same vec_id count as one vector. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored
from .components import components

COSINE = 0.9
BLOCKS = 4
PIVOTS = 64
SAMPLE_ROWS = 4096
GROUP_ROWS = 4096
LEAST_ROWS = 512
TILE = 1024
SLACK = 1e-5


def _rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _unit(column, rotation: np.ndarray | None = None) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x if rotation is None else x @ rotation


def _spans(size: int, blocks: int) -> list[slice]:
    edges = np.linspace(0, size, min(blocks, size) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _candidates(x: np.ndarray, y: np.ndarray, spans, budget: float) -> np.ndarray:
    """Pairs for which some block of coordinates is within its share of the budget."""
    near = np.zeros((len(x), len(y)), bool)
    for s in spans:
        a, b = x[:, s], y[:, s]
        share = budget * a.shape[1] / x.shape[1] + SLACK
        # One product gives |a|^2 - 2ab + |b|^2.
        one, two = (np.ones((len(z), 1), z.dtype) for z in (a, b))
        left = np.hstack([-2 * a, (a * a).sum(1, keepdims=True), one])
        right = np.hstack([b, two, (b * b).sum(1, keepdims=True)])
        near |= left @ right.T <= share
    return near


def links_between(x: np.ndarray, y: np.ndarray, spans, cosine: float) -> np.ndarray:
    """Matrix of links between unit vectors that are already rotated."""
    linked = np.zeros((len(x), len(y)), bool)
    small = [z.astype(np.float32) for z in (x, y)]
    for i in range(0, len(x), TILE):
        for j in range(0, len(y), TILE):
            near = _candidates(small[0][i:i + TILE], small[1][j:j + TILE], spans, 2 - 2 * cosine)
            at, to = np.nonzero(near)
            if len(at) * 20 > near.size:
                linked[i:i + TILE, j:j + TILE] = near & (
                    x[i:i + TILE] @ y[j:j + TILE].T >= cosine)
            elif len(at):
                ok = np.einsum("ij,ij->i", x[i + at], y[j + to]) >= cosine
                linked[i + at[ok], j + to[ok]] = True
    return linked


def _roots(linked: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray):
    """Smallest id reachable within a matrix of links, for rows and columns."""
    most = np.iinfo(np.int64).max
    at, to = np.nonzero(linked) if linked.sum() * 20 < linked.size else (None, None)
    x, y = ids_x.copy(), ids_y.copy()
    while True:
        before = (x.copy(), y.copy())
        if at is not None:
            np.minimum.at(x, at, y[to])
            np.minimum.at(y, to, x[at])
        else:
            for i in range(0, len(x), TILE):
                part = linked[i:i + TILE]
                x[i:i + TILE] = np.minimum(
                    x[i:i + TILE], np.where(part, y[None, :], most).min(1, initial=most))
                y = np.minimum(y, np.where(part, x[i:i + TILE, None], most).min(
                    0, initial=most))
        if (before[0] == x).all() and (before[1] == y).all():
            return x, y


def _points(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the usable vectors, one row for each id."""
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    full = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda v: v != 0))
    # Of rows that share an id the smallest vector counts, whatever the order they come in.
    return full.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def links_and_components(points: DataFrame, *, cosine: float, blocks: int, group_rows: int,
                         sample_rows: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Links (id, n) and components (node, component) among rows (id, copies, embedding).

    ``points`` is stored and all its vectors have one length.
    """
    spark = points.sparkSession
    n = points.count()
    first = points.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("embedding")
    sample = _unit(pa.array([r.embedding for r in first.collect()]))
    size = sample.shape[1]
    rotation, spans = _rotation(size), _spans(size, blocks)
    # Pivots: points of the sample far from each other, found greedily.
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(pivots, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    centers = sample[chosen]
    rows = int(np.clip(-(-n // 16), LEAST_ROWS, group_rows))

    def place(batches):
        for batch in batches:
            x = _unit(batch.column("embedding"))
            near = x @ centers.T
            at = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("copies"), batch.column("embedding"),
                 pa.array(at.astype(np.int32)), pa.array(-near[np.arange(len(x)), at])],
                ["id", "copies", "embedding", "pivot", "far"])

    kind = points.schema["embedding"].dataType.simpleString()
    fields = f"id long, copies long, embedding {kind}"
    placed = points.select("id", "copies", "embedding").mapInArrow(
        place, f"{fields}, pivot int, far double")
    ordered = numbered(placed, F.col("pivot"), F.col("far"), F.col("id"))
    grouped = stored(ordered.select(
        "id", "copies", "embedding", F.expr(f"number div {rows}").cast("int").alias("g")))

    def boxes(batches):
        low, high = {}, {}
        for batch in batches:
            x, g = _unit(batch.column("embedding"), rotation), batch.column("g").to_numpy()
            for k in np.unique(g):
                part = x[g == k]
                low[k] = np.minimum(low.get(k, np.inf), part.min(0))
                high[k] = np.maximum(high.get(k, -np.inf), part.max(0))
        keys = list(low)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([low[k].tolist() for k in keys],
                                                  pa.list_(pa.float64())),
             pa.array([high[k].tolist() for k in keys], pa.list_(pa.float64()))],
            ["g", "low", "high"])

    found = grouped.select("g", "embedding").mapInArrow(
        boxes, "g int, low array<double>, high array<double>").collect()
    groups = max((r.g for r in found), default=-1) + 1
    low, high = np.full((groups, size), np.inf), np.full((groups, size), -np.inf)
    for r in found:
        low[r.g], high[r.g] = np.minimum(low[r.g], r.low), np.maximum(high[r.g], r.high)
    partners: list[list[int]] = [[] for _ in range(groups)]
    budget = 2 - 2 * cosine
    for i in range(groups):
        gap = np.maximum(np.maximum(low[i] - high[i:], low[i:] - high[i]), 0.0) ** 2
        ok = np.zeros(groups - i, bool)
        for s in spans:
            ok |= gap[:, s].sum(axis=1) <= budget * (s.stop - s.start) / size + SLACK
        for j in (i + np.flatnonzero(ok)).tolist():
            partners[i].append(j)
            if j != i:
                partners[j].append(i)

    def route(batches):
        for batch in batches:
            g = batch.column("g").to_numpy()
            for own in np.unique(g):
                at = pa.array(np.flatnonzero(g == own))
                part = batch.take(at)
                for other in partners[own]:
                    key = min(own, other) * groups + max(own, other)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), key, np.int64)), part.column("g"),
                         part.column("id"), part.column("copies"), part.column("embedding")],
                        ["pair", "g", "id", "copies", "embedding"])

    def compare(table: pa.Table) -> pa.Table:
        g = table.column("g").to_numpy()
        pair = int(table.column("pair")[0].as_py())
        one, two = divmod(pair, groups)
        ids, copies = (table.column(c).to_numpy() for c in ("id", "copies"))
        x = _unit(table.column("embedding"), rotation)
        a = np.flatnonzero(g == one)
        b = a if one == two else np.flatnonzero(g == two)
        linked = links_between(x[a], x[b], spans, cosine)
        if one == two:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(ids), np.int64)
        links[a] += linked @ copies[b]
        root = ids.copy()
        root_a, root_b = _roots(linked, ids[a], ids[b])
        root[a] = root_a
        if one != two:
            links[b] += linked.T @ copies[a]
            root[b] = np.minimum(root[b], root_b)
        some = np.flatnonzero(links > 0)
        return pa.table({"id": ids[some], "n": links[some], "root": root[some]})

    routed = grouped.mapInArrow(route, f"pair long, g int, {fields}")
    parts = stored(routed.groupBy("pair").applyInArrow(
        compare, "id long, n long, root long"))
    counts = parts.groupBy("id").agg(F.sum("n").alias("n"))
    return counts, components(parts.select(F.col("id").alias("a"), F.col("root").alias("b")))


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE, blocks: int = BLOCKS,
                 group_rows: int = GROUP_ROWS, sample_rows: int = SAMPLE_ROWS,
                 pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``."""
    usable = stored(_points(vectors))
    points = stored(usable.groupBy("embedding").agg(
        F.min("vec_id").cast("long").alias("id"), F.count("*").alias("copies")))
    members = usable.join(
        points.select("embedding", "id", "copies"), "embedding").select("vec_id", "id", "copies")
    result = None
    for size in [r.k for r in points.select(F.size("embedding").alias("k")).distinct().collect()]:
        counts, found = links_and_components(
            stored(points.where(F.size("embedding") == size)), cosine=cosine, blocks=blocks,
            group_rows=group_rows, sample_rows=sample_rows, pivots=pivots)
        rows = counts.join(found.withColumnRenamed("node", "id"), "id", "left")
        result = rows if result is None else result.unionByName(rows)
    ids = vectors.select("vec_id")
    if result is None:
        joined = ids.withColumn("n_links", F.lit(0).cast("long")).withColumn(
            "component_id", F.col("vec_id").cast("long"))
    else:
        known = stored(members.join(stored(result), "id", "left").select(
            "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id")))
        joined = ids.join(known, "vec_id", "left").select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(
        F.col("vec_id") == F.col("component_id"), F.lit(False)))


# The same from the definition: all pairs, and what each reaches.
SQL = r"""
WITH RECURSIVE whole AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
usable AS MATERIALIZED (
  SELECT vec_id, e, list_inner_product(e, e) AS q FROM whole
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_inner_product(a.e, b.e) >= 0.9 * sqrt(a.q) * sqrt(b.q)),
reached(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS least FROM reached GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links,
  least(vec_id, coalesce(least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM whole LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""
