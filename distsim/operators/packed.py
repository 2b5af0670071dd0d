"""Similarities of packed vectors: a cell of target blocks is one sparse product.

The cells are those of :mod:`~distsim.operators.similarity`, but the vectors of a block are one
row, packed into three compressed tables (targets, contexts, entries), and no entry is copied. A
block is shuffled once; the task of a cell fetches the two blocks from where they lie, as a
cartesian product of partitions does. It multiplies them with numpy, a slice of targets at a time:

* rows of pairs, one for each context that two targets share, are numbers in an array of bounded
  length (``ROWS``). They are summed as they arise, so none is written, hashed or spilled;
* a pair below the cosine is dropped before its other sums are made and its words are written;
* bytes on disk depend on the entries alone, and a cell's memory on the entries of two blocks.

With ``size`` a cell gives only what can be among the ``size`` nearest of a target: the best of
the cell in each direction, packed into one row for each of its blocks. A task ranks those of a
block, the rows of a few cells at a time.

Dot products are summed as doubles, exact up to 2 ** 53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..sources.shipping import ship

# Contexts in one row, rows of pairs held at once, and sums in a dense array for each of them.
PART, ROWS, DENSE = 2048, 1 << 18, 32
# Cosines are ranked with six decimals.
MILLION = 1e6
# Steps of the cosine by which neighbors are counted before they are sorted.
BINS = 64
# Cells per partition: more of them hold fewer entries each, and fetch a block more often.
CELLS_PER_PARTITION = 2

# What a block's vectors are packed into.
TABLES = ["targets", "contexts", "entries"]

SUMS = ["dot", "shared", "norm", "total"]
FAR_SUMS = ["least", "skew1", "skew2", "js", "squares", "s1", "own1"]


def grid(partitions: int | None, blocks: int | None, default: int) -> int:
    """Blocks so that their pairs fill the partitions."""
    return blocks or math.ceil(math.sqrt(2 * CELLS_PER_PARTITION * (partitions or default)))


def _block(blocks: int) -> Column:
    return F.coalesce(F.pmod(F.hash("target"), F.lit(blocks)), F.lit(0))


def _vectors(
    entries: DataFrame, totals: DataFrame, blocks: int, rare: int | None, routed: bool
) -> DataFrame:
    """Parts of vectors with the totals of their target and the block of the target.

    A long vector is dealt in parts by a hash of the context, so no row grows with the
    vocabulary. With ``rare``, entries on contexts of one target are left out. ``routed`` adds
    ``_k``, the block a copy of a part goes to: every block, or, if at most ``rare`` targets have
    the context of an entry, those that have it.
    """
    ship(entries.sparkSession)
    sized = totals.withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    kept = [c for c in totals.columns if c != "size"]
    lists = {"context": "contexts", "n": "counts"}

    def pack(rows: DataFrame, *cells: str) -> DataFrame:
        part = F.pmod(F.hash("context"), F.col("parts"))
        fields = [F.col(c).cast("double").alias(c) if c == "n" else F.col(c) for c in lists]
        packed = rows.groupBy("target", part.alias("part"), *cells).agg(
            F.collect_list(F.struct(*fields)).alias("v"),
            *[F.first(c).alias(c) for c in kept if c != "target"],
        )
        return packed.select(
            *kept, *cells, *[F.col(f"v.{c}").alias(name) for c, name in lists.items()])

    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = entries.join(sized, "target")
    if "level" in entries.columns:
        lists["low"] = "lows"
        rows = rows.withColumn("low", F.col("level") <= F.col("cut"))
    if rare is None:
        vectors = pack(rows)
        if routed:
            vectors = vectors.withColumn("_k", everywhere)
    else:
        # At most one number for each block, however many targets have the context.
        held = entries.groupBy("context").agg(
            F.count("n").alias("df"), F.collect_set(_block(blocks)).alias("_ks"))
        rows = rows.join(held, "context").where(F.col("df") > 1)
        if routed:
            few = rows.where(F.col("df") <= rare).withColumn("_k", F.explode("_ks"))
            vectors = pack(rows.where(F.col("df") > rare)).withColumn("_k", everywhere).unionByName(
                pack(few, "_k"))
        else:
            vectors = pack(rows)
    return vectors.withColumn("block", _block(blocks))


def packed_cells(
    entries: DataFrame, totals: DataFrame, blocks: int, partitions: int, rare: int | None = None
) -> DataFrame:
    """Parts of vectors as rows, copied to each cell of their block (see :func:`_vectors`).

    For cells that are to be joined or inspected as tables; :func:`block_pairs` copies nothing.
    """
    copies = _vectors(entries, totals, blocks, rare, True)
    i, j = F.col("i"), F.col("j")
    cells = copies.withColumns(
        {"i": F.least("block", "_k"), "j": F.greatest("block", "_k")}
    ).drop("_k")
    # Cells are dealt in turn: few of them would fall unevenly by hash.
    turn = F.pmod(F.floor(j * (j + 1) / 2).cast("int") + i, F.lit(partitions))
    return cells.withColumn("turn", turn).repartitionById(partitions, F.col("turn"))


def block_pairs(
    entries: DataFrame, totals: DataFrame, blocks: int, rare: int | None = None
) -> DataFrame:
    """One row a cell (i, j), i <= j: the packed tables of both blocks.

    Blocks are one partition each, so a task of the product has one cell. Its rows are those of
    a join without keys, which reads both blocks from their shuffle and writes nothing.
    """
    vectors = _vectors(entries, totals, blocks, rare, False)
    tables = ", ".join(f"{name} binary" for name in TABLES)
    one = vectors.repartitionById(blocks, F.col("block")).groupBy("block").applyInArrow(
        _pack_block, f"block int, {tables}").repartitionById(blocks, F.col("block"))

    def side(cell: str, name: str) -> DataFrame:
        return one.select(F.col("block").alias(cell), *[F.col(t).alias(f"{name}_{t}") for t in TABLES])

    return side("i", "x").hint("shuffle_replicate_nl").join(
        side("j", "y"), F.col("i") <= F.col("j"))


def _stored(columns: dict) -> bytes:
    """Columns as a compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
    out = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(out, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _loaded(data: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks()


def _small(v: np.ndarray) -> np.ndarray:
    """Numbers in four bytes, if those hold them."""
    with np.errstate(invalid="ignore"):
        small = v.astype(np.int32)
    return small if np.array_equal(small, v) else v


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words in byte order, the place of each word among them)."""
    found = words.dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), rank[found.indices.to_numpy()]


def _pack_block(
    key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """The packed tables of a block, entries by target and context."""
    table = pa.Table.from_batches(list(batches))
    words, row = _ranked(_column(table, "target"))
    targets = {"target": words}
    for name in ("s", "q", "own", "word", "cut", "rest"):
        if name in table.column_names:
            targets[name] = np.zeros(len(words))
            targets[name][row] = table[name].to_numpy()
    lists = _column(table, "contexts")
    contexts, context = _ranked(lists.flatten())
    target = np.repeat(row, pc.list_value_length(lists).to_numpy())
    order = np.lexsort((context, target))
    entries = {"target": _small(target[order]), "context": _small(context[order]),
               "n": _small(_column(table, "counts").flatten().to_numpy()[order])}
    if "lows" in table.column_names:
        flags = _column(table, "lows").flatten().to_numpy(zero_copy_only=False)
        entries["lows"] = flags[order]
    stored = [_stored(targets), _stored({"context": contexts}), _stored(entries)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), *[pa.array([v], pa.binary()) for v in stored]],
        names=["block", *TABLES])


def _entropy(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """:func:`~distsim.functions.measures.relative_entropy` of positive ``p``."""
    return p * np.log(p / (M.ALPHA * q + M.BETA * p))


def _halves(v: np.ndarray, jsd: str) -> np.ndarray:
    return np.floor(v / 2) if jsd == "integer" else v / 2.0


class _Cell:
    """The vectors of a cell: targets in byte order, entries with target, context and weight.

    Of two blocks, only entries on contexts that both have are kept: the others are in the totals.
    """

    def __init__(self, blocks: list[tuple[pa.Table, ...]]):
        words = pa.concat_arrays([_column(b[0], "target") for b in blocks])
        order = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words = words.take(pa.array(order))
        self.totals = {
            name: np.concatenate([b[0][name].to_numpy() for b in blocks])[order]
            for name in blocks[0][0].column_names if name != "target"}
        self.root = np.sqrt(self.totals["q"])
        sizes = [b[0].num_rows for b in blocks]
        self.block = np.repeat(np.arange(len(blocks)), sizes)[order]
        known = _column(blocks[0][1], "context")
        parts, offset = [], 0
        for k, (_, contexts, entries) in enumerate(blocks):
            target = rank[offset + entries["target"].to_numpy().astype(np.int64)]
            code = entries["context"].to_numpy().astype(np.int64)
            offset += sizes[k]
            if k:
                shared = pc.index_in(_column(contexts, "context"), known)
                code = pc.fill_null(shared, -1).to_numpy().astype(np.int64)[code]
            parts.append([target, code, entries["n"].to_numpy().astype(np.float64)] + [
                entries["lows"].to_numpy() for _ in range("lows" in entries.column_names)])
        if len(blocks) > 1:
            there = np.zeros(len(known), bool)
            there[parts[1][1][parts[1][1] >= 0]] = True
            kept = [there[parts[0][1]], parts[1][1] >= 0]
            parts = [[v[keep] for v in part] for part, keep in zip(parts, kept)]
        self.target, self.context, self.n, *low = (np.concatenate(v) for v in zip(*parts))
        self.low = low[0] if low else None

    def side(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries of one block that are multiplied, and its targets."""
        mine = self.block[self.target] == block
        if self.low is not None:
            mine &= self.low
        return np.flatnonzero(mine), np.flatnonzero(self.block == block)


def _slices(rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of targets whose rows of pairs fit the bound; a run has one target at least."""
    start, held = 0, 0
    for k, many in enumerate(rows.tolist()):
        if k > start and held + many > ROWS:
            yield start, k
            start, held = k, 0
        held += many
    if start < len(rows):
        yield start, len(rows)


def _met(cell: _Cell, i: int, j: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first target, second target, first weight, second weight) of rows of pairs.

    All rows of a pair come in one slice. Within a block a pair is met once, the smaller first.
    """
    ones, first = cell.side(i)
    twos, second = cell.side(j)
    if not len(ones) or not len(twos):
        return
    # The second block by context: where each context's entries begin.
    twos = twos[np.argsort(cell.context[twos], kind="stable")]
    starts = np.searchsorted(cell.context[twos], np.arange(cell.context.max() + 2))
    many = np.diff(starts)[cell.context[ones]]
    ones, many = ones[many > 0], many[many > 0]
    # Targets with few rows of pairs stand together, so that their sums can be sorted.
    rows = np.bincount(cell.target[ones], many, len(cell.words))
    first = first[rows[first] > 0]
    first = first[np.argsort(rows[first], kind="stable")]
    place = np.empty(len(cell.words), np.int64)
    place[first] = np.arange(len(first))
    by = np.argsort(place[cell.target[ones]], kind="stable")
    ones, many = ones[by], many[by]
    bounds = np.searchsorted(place[cell.target[ones]], np.arange(len(first) + 1))
    for lo, hi in _slices(rows[first].astype(np.int64)):
        mine, times = ones[bounds[lo]:bounds[hi]], many[bounds[lo]:bounds[hi]]
        ends = np.cumsum(times)
        a = np.repeat(mine, times)
        b = twos[np.arange(ends[-1]) + np.repeat(starts[cell.context[mine]] - ends + times, times)]
        ta, tb = cell.target[a], cell.target[b]
        if i == j:
            once = ta < tb
            a, b, ta, tb = a[once], b[once], ta[once], tb[once]
        if len(a):
            yield ta, tb, cell.n[a], cell.n[b], first[lo:hi], second


def _found(cell: _Cell, met: tuple, sim_min: float) -> tuple[np.ndarray, ...]:
    """(first, second, dot, norm, rows kept, their pair) of the pairs that reach the cosine."""
    ta, tb, na, nb, first, second = met
    local = np.empty(len(cell.words), np.int64)
    local[first] = np.arange(len(first))
    high = local[ta] * len(second)
    local[second] = np.arange(len(second))
    key, width = high + local[tb], len(first) * len(second)
    dense = width <= DENSE * len(key)
    if dense:
        sums = np.bincount(key, na * nb, width)
        pairs = np.flatnonzero(sums)
        dot = sums[pairs]
    else:
        pairs, inverse = np.unique(key, return_inverse=True)
        dot = np.bincount(inverse, na * nb, len(pairs))
    one, two = first[pairs // len(second)], second[pairs % len(second)]
    norm = cell.root[one] * cell.root[two]
    if cell.low is not None:
        at = np.flatnonzero(dot + _bound(cell, one, two) * norm >= sim_min * norm * (1 - 1e-9))
        return one[at], two[at]
    near = dot >= sim_min * norm * (1 - 1e-12)
    if "word" in cell.totals:
        near &= (cell.totals["word"][one] > 0) | (cell.totals["word"][two] > 0)
    near[near] = dot[near] / norm[near] >= sim_min
    at = np.flatnonzero(near)
    if dense:
        place = np.full(width, -1, np.int32)
        place[pairs[at]] = np.arange(len(at))
        pair = place[key]
    else:
        place = np.full(len(pairs), -1, np.int32)
        place[at] = np.arange(len(at))
        pair = place[inverse]
    return one[at], two[at], dot[at], norm[at], pair


def _bound(cell: _Cell, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Most that the entries of a pair that were not multiplied can add to its cosine."""
    cut, rest = cell.totals["cut"], cell.totals["rest"]
    a, b = cut[one], cut[two]
    return np.where(a < b, rest[one], np.where(a > b, rest[two], rest[one] * rest[two]))


class _Lookup:
    """Rows of pairs of given targets, by looking up the entries of the one in the other."""

    def __init__(self, cell: _Cell):
        self.cell, self.width = cell, int(cell.context.max(initial=0)) + 1
        key = cell.target * self.width + cell.context
        self.order = np.argsort(key)
        self.key = key[self.order]
        self.starts = np.searchsorted(self.key, np.arange(len(cell.words) + 1) * self.width)

    def met(self, one: np.ndarray, two: np.ndarray, sim_min: float) -> Iterator[tuple]:
        """(rows of pairs as of :func:`_met`, found as of :func:`_found`), bounded in rows."""
        cell, size = self.cell, np.diff(self.starts)
        less = size[one] <= size[two]
        few, other = np.where(less, one, two), np.where(less, two, one)
        for lo, hi in _slices(size[few]):
            times = size[few[lo:hi]]
            pair, ends = np.repeat(np.arange(hi - lo), times), np.cumsum(times)
            a = np.arange(ends[-1]) + np.repeat(self.starts[few[lo:hi]] - ends + times, times)
            wanted = self.key[a] + (other - few)[lo:hi][pair] * self.width
            b = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[b] == wanted
            pair, a, b = pair[hit], self.order[a[hit]], self.order[b[hit]]
            # The first target of the pair first, as in the rows of a product.
            a, b = np.where(less[lo:hi][pair], a, b), np.where(less[lo:hi][pair], b, a)
            dot = np.bincount(pair, cell.n[a] * cell.n[b], hi - lo)
            norm = cell.root[one[lo:hi]] * cell.root[two[lo:hi]]
            at = np.flatnonzero(dot / norm >= sim_min)
            place = np.full(hi - lo, -1, np.int64)
            place[at] = np.arange(len(at))
            yield ((cell.target[a], cell.target[b], cell.n[a], cell.n[b]),
                   (one[lo + at], two[lo + at], dot[at], norm[at], place[pair]))


def _sums(cell: _Cell, met: tuple, found: tuple, distances: bool, jsd: str) -> dict:
    """The sums of :func:`~distsim.operators.similarity._summed`, the smaller target first."""
    ta, tb, na, nb = met[:4]
    one, two, dot, norm, pair = found
    s = cell.totals["s"]
    kept = np.flatnonzero(pair >= 0)
    pair, na, nb = pair[kept], na[kept], nb[kept]

    def add(weights: np.ndarray) -> np.ndarray:
        return np.bincount(pair, weights, len(one))

    swap = one > two
    least, most = np.where(swap, two, one), np.where(swap, one, two)
    out = {"target1": least, "target2": most, "dot": dot, "shared": add(na + nb), "norm": norm,
           "total": s[one] + s[two]}
    if distances:
        turned = swap[pair]
        v1, v2 = np.where(turned, nb, na), np.where(turned, na, nb)
        mean = _halves(v1 + v2, jsd)
        out["least"] = add(np.minimum(v1, v2))
        out["skew1"] = add(_entropy(v1, v2) - v1 * M.LN_ABSENT)
        out["skew2"] = add(_entropy(v2, v1) - v2 * M.LN_ABSENT)
        out["js"] = add(_entropy(v1, mean) + _entropy(v2, mean)
                        - _entropy(v1, _halves(v1, jsd)) - v2 * M.LN_HALF)
        out["squares"] = cell.totals["q"][one] + cell.totals["q"][two]
        out["s1"], out["own1"] = s[least], cell.totals["own"][least]
    return out


def _written(cell: _Cell, columns: dict) -> pa.RecordBatch:
    arrays = [cell.words.take(pa.array(v)) if v.dtype == np.int64 else pa.array(v)
              for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Cell, int, int]]:
    """Cells with the places of their two blocks in them, from rows of :func:`block_pairs`."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            alone = row["i"].as_py() == row["j"].as_py()
            cell = _Cell([tuple(_loaded(row[f"{side}_{t}"]) for t in TABLES)
                          for side in ("x" if alone else "xy")])
            cell.numbers = [row["i"].as_py()] if alone else [row["i"].as_py(), row["j"].as_py()]
            yield cell, 0, len(cell.numbers) - 1


def packed_sums(
    entries: DataFrame, totals: DataFrame, distances: bool, jsd: str, sim_min: float,
    blocks: int, rare: int | None = None,
) -> DataFrame:
    """Sums of every pair that reaches the cosine ``sim_min``.

    ``totals`` has target, size, s, q (and own) of each target's vector; with a column ``word``,
    pairs of two targets where it is zero are left out. With a column ``level`` of the
    entries (and ``cut`` and ``rest`` of the totals) only entries up to the cut are multiplied;
    pairs that the others can lift to the cosine get all shared contexts by lookups.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, first, second in _cells(batches):
            lookup = None if cell.low is None else _Lookup(cell)
            for met in _met(cell, first, second):
                found = _found(cell, met, sim_min)
                pairs = [(met, found)] if lookup is None else lookup.met(*found, sim_min)
                for rows, some in pairs:
                    if len(some[0]):
                        yield _written(cell, _sums(cell, rows, some, distances, jsd))

    names = SUMS + (FAR_SUMS if distances else [])
    schema = "target1 string, target2 string, " + ", ".join(f"{c} double" for c in names)
    return block_pairs(entries, totals, blocks, rare).mapInArrow(multiply, schema)


def packed_nearest(
    entries: DataFrame, totals: DataFrame, size: int, sim_min: float, blocks: int,
) -> DataFrame:
    """target, neighbor, cosine: the ``size`` best of each target.

    Cosines have six decimals, ties are broken by neighbor.
    """

    def rank(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        held, many, kept = [], 0, 0
        for batch in batches:
            for data in batch.column("rows"):
                held.append(_loaded(data))
                many += held[-1].num_rows
                if many > 2 * kept + 4 * ROWS:
                    held = [_first(held, size)]
                    many = kept = held[0].num_rows
        found = _first(held, size)
        yield pa.RecordBatch.from_arrays(
            [*[_column(found, c).dictionary_decode() for c in ("target", "neighbor")],
             pa.array(found["cosine"].to_numpy() / MILLION)], names=found.column_names)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, first, second in _cells(batches):
            held = _Best(size, len(cell.words))
            for met in _met(cell, first, second):
                one, two, dot, norm, _ = _found(cell, met, sim_min)
                if len(one):
                    cosine = dot / norm
                    held.add(one, two, cosine)
                    held.add(two, one, cosine)
            for columns in held.best():
                for k, block in enumerate(cell.numbers):
                    mine = np.flatnonzero(cell.block[columns["target"]] == k)
                    yield _candidates(cell, block, {c: v[mine] for c, v in columns.items()})

    best = block_pairs(entries, totals, blocks).mapInArrow(multiply, "block int, rows binary")
    return best.repartitionById(blocks, F.col("block")).groupBy("block").applyInArrow(
        rank, "target string, neighbor string, cosine double")


def _coded(words: pa.Array, codes: np.ndarray) -> pa.DictionaryArray:
    """The words of the codes, with a dictionary of no others."""
    used, code = np.unique(codes, return_inverse=True)
    return pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), words.take(pa.array(used)))


def _candidates(cell: _Cell, block: int, columns: dict) -> pa.RecordBatch:
    """Neighbors of targets of one block in a row: words once, cosines in millionths."""
    rows = {c: _coded(cell.words, columns[c]) for c in ("target", "neighbor")}
    rows["cosine"] = np.rint(columns["cosine"] * MILLION).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([_stored(rows)], pa.binary())],
        names=["block", "rows"])


def _first(tables: list[pa.Table], size: int) -> pa.Table:
    """The ``size`` best rows of each target of coded tables, ties by neighbor."""
    table = pa.concat_tables(tables).unify_dictionaries()
    words, codes = {}, {}
    for name in ("target", "neighbor"):
        column = _column(table, name)
        words[name], rank = _ranked(column.dictionary)
        codes[name] = rank[column.indices.to_numpy()]
    cosine = table["cosine"].to_numpy()
    order = np.lexsort((codes["neighbor"], -cosine, codes["target"]))
    target = codes["target"][order]
    begins = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    rank = np.arange(len(target)) - np.repeat(begins, np.diff(np.r_[begins, len(target)]))
    best = order[rank < size]
    return pa.table({
        **{name: _coded(words[name], code[best]) for name, code in codes.items()},
        "cosine": cosine[best]})


def _six_decimals(x: np.ndarray) -> np.ndarray:
    """Half-even rounding of the decimal digits, as Spark's ``bround``."""
    scaled = x * 1e6
    out = np.rint(scaled) / 1e6
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6).tolist():
        out[k] = float(round(Decimal(repr(float(x[k]))), 6))
    return out


class _Best:
    """The ``size`` best neighbors of each target among the rows added so far."""

    def __init__(self, size: int, targets: int):
        self.size, self.rows, self.many, self.kept = size, [], 0, 0
        # What a row must reach to be among them, known after the first cut.
        self.least = np.full(targets, -1.0)

    def add(self, target: np.ndarray, neighbor: np.ndarray, cosine: np.ndarray) -> None:
        keep = np.flatnonzero(cosine >= self.least[target] - 1e-6)
        self.rows.append((target[keep], neighbor[keep], _six_decimals(cosine[keep])))
        self.many += len(keep)
        if self.many > 2 * self.kept + 4 * ROWS:
            self._cut()

    def _cut(self) -> None:
        target, neighbor, cosine = (np.concatenate(c) for c in zip(*self.rows))
        # Only the bins of a target that hold its first rows are sorted.
        step = np.minimum((cosine * BINS).astype(np.int64), BINS - 1)
        counts = np.bincount(target * BINS + step, minlength=len(self.least) * BINS)
        above = np.cumsum(counts.reshape(-1, BINS)[:, ::-1], axis=1) < self.size
        top = np.flatnonzero(step >= BINS - 1 - above.sum(axis=1)[target])
        target, neighbor, cosine = target[top], neighbor[top], cosine[top]
        order = np.lexsort((neighbor, -cosine, target))
        target, neighbor, cosine = target[order], neighbor[order], cosine[order]
        begins = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        rank = np.arange(len(target)) - np.repeat(begins, np.diff(np.r_[begins, len(target)]))
        last = rank == self.size - 1
        self.least[target[last]] = cosine[last]
        kept = rank < self.size
        self.rows = [(target[kept], neighbor[kept], cosine[kept])]
        self.many = self.kept = int(kept.sum())

    def best(self) -> Iterator[dict]:
        if self.many:
            self._cut()
            yield dict(zip(("target", "neighbor", "cosine"), self.rows[0]))
