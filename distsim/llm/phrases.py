"""Phrases whose words occur together, counted in lossless counting quotient filters.

Phrases are two to ``longest`` words in a row within a piece of text, counted by language. A
candidate is found at least ``least`` times; its score is the smallest, over the places where
it can be cut in two, of what its count is above that expected of its two parts.

Words get numbers. Tasks number the words of their texts for themselves (a shard); only the
distinct words of each shard are dealt, by word, and are answered with the numbers of those that
are frequent enough to be in a candidate. So neither the vocabulary nor the
tokens have to fit one place, and no tokens are shuffled by word.

Counting quotient filters. A phrase of n numbers of B bits is n * B bits wide. Rounds that
replace one number by its exclusive or with a hash of another permute these values; that can be
undone, and the first number comes out as a hash of all. A filter keeps its values in order:
the leading bits, the quotient, as the lengths of runs, the remaining bits in full, with a
counter each (after Pandey, Bender, Johnson and Patro, "A General-Purpose Counting Filter",
2017). Nothing is rounded off, so counts are exact and phrases can be read back. A shard's
filters are dealt by the first bits of the quotient; merging them adds the counters of equal
values of sorted runs, and a phrase of whatever frequency has one entry a shard.

A phrase of n words is counted only where both its phrases of n - 1 words are frequent, which
each shard is told for its own values after every length. Cuts, containing phrases and ranks are
joins, aggregations and windows over the frequent phrases.

Edges: a null text has no words, a null language is ``und``. Documents need no id; repeated
rows count repeatedly. Every character but the separators belongs to words. An empty table
gives an empty result; products are taken in decimals of 38 digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import has_rows, stored, values
from .repeats import _loosen as loosen
from .repeats import _packed, _runs, _unpacked
from .repeats import _squeeze as squeeze

LEAST = 100
LONGEST = 5
TOP = 2000
SHARD_TOKENS = 1 << 22
BUCKET_BYTES = 1 << 24
UNKNOWN = "und"
_STEPS = np.random.default_rng(13).integers(1 << 32, 1 << 63, (64, 2), dtype=np.uint64)

# Separators of pieces become line ends, those of words blanks, A-Z small letters.
_CLEAN = bytes(
    10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b
    for b in range(256))


# --- filters -------------------------------------------------------------------------


class Permutation:
    """Phrases of ``n`` numbers of ``bits`` bits as permuted values, in columns of 64 bits.

    Values are left-aligned in each column, the first number foremost.
    """

    def __init__(self, n: int, bits: int):
        self.n, self.bits, self.per = n, bits, 64 // bits
        self.columns = -(-n // self.per)

    def _round(self, x: np.ndarray, k: int) -> np.ndarray:
        mixed = (x + _STEPS[k, 0]) * (_STEPS[k, 1] | np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed >> np.uint64(64 - self.bits)

    def width(self, column: int) -> int:
        """Bits used in a column."""
        return self.bits * min(self.per, self.n - column * self.per)

    def values(self, phrases: list[np.ndarray]) -> list[np.ndarray]:
        lanes = [p.astype(np.uint64) for p in phrases]
        for k in range(2 * self.n + 1):
            at = k % self.n
            lanes[at] = lanes[at] ^ self._round(lanes[at - 1], k)
        out = []
        for c in range(self.columns):
            value = np.zeros(len(lanes[0]), np.uint64)
            for k, lane in enumerate(lanes[c * self.per:(c + 1) * self.per]):
                value |= lane << np.uint64(64 - (k + 1) * self.bits)
            out.append(value)
        return out

    def phrases(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        lanes = [(columns[k // self.per] >> np.uint64(64 - (k % self.per + 1) * self.bits)) & mask
                 for k in range(self.n)]
        for k in reversed(range(2 * self.n + 1)):
            at = k % self.n
            lanes[at] = lanes[at] ^ self._round(lanes[at - 1], k)
        return lanes


def _planes(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers below 256 ** ``width`` as one value: all first bytes, all second bytes, and so on."""
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return _packed(np.ascontiguousarray(planes).reshape(-1))


def _of_planes(blob: bytes, width: int = 4) -> np.ndarray:
    planes = _unpacked(blob, np.uint8)[0].reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}")


def _sorted(columns: list[np.ndarray]) -> np.ndarray:
    if len(columns) == 1:
        return np.argsort(columns[0], kind="stable")
    return np.lexsort(columns[::-1])


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal values."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class QuotientFilter:
    """Values in order, with counters: runs by quotient, full remainders, counters."""

    def __init__(self, columns: list[np.ndarray], counts: np.ndarray):
        self.columns, self.counts = columns, counts

    @classmethod
    def of(cls, columns: list[np.ndarray], counts: np.ndarray | None = None) -> QuotientFilter:
        """Filter of values in any order, equal ones counted together."""
        order = _sorted(columns)
        columns = [c[order] for c in columns]
        start = _starts(columns)
        if counts is None:
            counts = np.diff(np.append(start, len(order)))
        else:
            counts = np.add.reduceat(counts[order], start) if len(start) else counts
        return cls([c[start] for c in columns], counts.astype(np.int64))

    def parts(self, lead: int) -> Iterator[tuple[int, QuotientFilter]]:
        """(first ``lead`` bits, filter of the values that begin with them)."""
        head = self.columns[0] >> np.uint64(64 - lead) if lead else np.zeros_like(self.columns[0])
        start = _runs(head)
        for a, b in zip(start, np.append(start[1:], len(head))):
            yield int(head[a]), QuotientFilter([c[a:b] for c in self.columns], self.counts[a:b])

    def encode(self, permutation: Permutation, lead: int) -> list[bytes]:
        """[head, runs, remainders, counters]; the first ``lead`` bits are equal in all values."""
        n, first = len(self.counts), permutation.width(0)
        q = min(lead + max(n, 1).bit_length() - 1, first, 63)
        q = max(q, lead)
        # A few bits more, if remainders are then whole bytes.
        if (more := (first - q) % 8) <= 3:
            q = min(q + more, 63)
        low = self.columns[0] << np.uint64(q)
        quotient = (self.columns[0] >> np.uint64(64 - q)) & np.uint64((1 << (q - lead)) - 1) \
            if q > lead else np.zeros(n, np.uint64)
        runs = np.bincount(quotient.astype(np.int64), minlength=1 << (q - lead))
        full = []
        for k, column in enumerate([low, *self.columns[1:]]):
            used = -(-max(permutation.width(k) - (q if k == 0 else 0), 0) // 8)
            full.append(column.astype(">u8").view(np.uint8).reshape(n, 8)[:, :used])
        return [np.array([n, q], np.int64).tobytes(), _planes(runs),
                np.ascontiguousarray(np.concatenate(full, axis=1)).tobytes(),
                _planes(self.counts, 8)]

    @classmethod
    def decode(cls, parts: list[bytes], permutation: Permutation, lead: int, head: int
               ) -> QuotientFilter:
        n, q = np.frombuffer(parts[0], np.int64).tolist()
        runs = _of_planes(parts[1])
        quotient = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
        quotient |= np.uint64(head << (q - lead))
        used = [-(-max(permutation.width(k) - (q if k == 0 else 0), 0) // 8)
                for k in range(permutation.columns)]
        full = np.frombuffer(parts[2], np.uint8).reshape(n, sum(used))
        columns, at = [], 0
        for u in used:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :u] = full[:, at:at + u]
            columns.append(wide.view(">u8").ravel().astype(np.uint64))
            at += u
        columns[0] >>= np.uint64(q)
        if q:
            columns[0] |= quotient << np.uint64(64 - q)
        return cls(columns, _of_planes(parts[3], 8).astype(np.int64))


def merged(filters: list[QuotientFilter]) -> QuotientFilter:
    """One filter with the sums of all."""
    columns = [np.concatenate(c) for c in zip(*(f.columns for f in filters))]
    return QuotientFilter.of(columns, np.concatenate([f.counts for f in filters]))


def members(some: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Whether each value is among ``some``."""
    if not len(some[0]) or not len(columns[0]):
        return np.zeros(len(columns[0]), bool)
    for seed in range(1, 64):
        keys, wanted = (_key(x, seed) for x in (some, columns))
        order = np.argsort(keys)
        keys = keys[order]
        if (keys[1:] != keys[:-1]).all():
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[at] == wanted
            for a, b in zip(some, columns):
                found &= a[order][at] == b
            return found
    raise ValueError("values must be distinct")


def _key(columns: list[np.ndarray], seed: int) -> np.ndarray:
    if len(columns) == 1:
        return columns[0]
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = (key ^ c) * (_STEPS[seed, 1] | np.uint64(1))
        key ^= key >> np.uint64(31)
    return key


# --- shards --------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers of words in order of their first use; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _stream(tokens: np.ndarray, least: int) -> list[bytes]:
    """[tokens, words]: runs of ``least`` words or more, as places in a list of words.

    Shorter runs are left out, and breaks between runs are single. Places are by frequency,
    which packs well.
    """
    padded = np.concatenate([[0], tokens, [0]])
    edge = np.flatnonzero((padded[1:] != 0) != (padded[:-1] != 0))
    first, last = edge[0::2], edge[1::2]
    some = last - first >= least
    first, size = first[some], (last - first)[some]
    # Each run with one break after it.
    ends = np.cumsum(size + 1)
    kept = np.zeros(int(ends[-1]) if len(ends) else 0, tokens.dtype)
    inside = np.ones(len(kept), bool)
    inside[ends - 1] = False
    at = np.flatnonzero(inside)
    kept[at] = tokens[at + np.repeat(first - (ends - size - 1), size)]
    words, place, counts = np.unique(kept[at], return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(1, len(order) + 1)
    out = np.zeros(len(kept), np.uint32)
    out[at] = rank[place]
    return [_planes(out), _planes(words[order])]


def _tokens(stream: list[bytes]) -> np.ndarray:
    words = np.append(np.uint32(0), _of_planes(stream[1]))
    return words[_of_planes(stream[0])]


def _packed_words(words: list[bytes], counts: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Words with their counts and rising numbers in a shard as four values."""
    size = np.fromiter(map(len, words), np.uint32, len(words))
    return [_planes(size), _planes(counts, 8), _planes(np.diff(number, prepend=0)),
            squeeze(b"".join(words))]


def _unpacked_words(parts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    size, counts, steps = _of_planes(parts[0]), _of_planes(parts[1], 8), _of_planes(parts[2])
    text, ends = loosen(parts[3]), np.cumsum(size, dtype=np.int64).tolist()
    number = np.cumsum(steps, dtype=np.int64).astype(np.uint32)
    return [text[a:b] for a, b in zip([0, *ends], ends)], counts.astype(np.int64), number


def _packed_known(at: np.ndarray, ids: np.ndarray) -> bytes:
    """Rising numbers of words in a shard, and their numbers in the vocabulary."""
    return _planes(np.concatenate([np.diff(at.astype(np.int64), prepend=0), ids]))


def _unpacked_known(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, ids = np.split(_of_planes(blob), 2)
    return np.cumsum(steps, dtype=np.int64), ids


_SHARD = "shard string, lang string, tokens binary, total long, bucket long, words array<binary>"


def _shards(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of shards (shard, lang, tokens, total) and of their words (shard, lang, bucket,
    words), stored: texts as numbers of the words of their shard."""

    def run(batches):
        open_: dict[str, tuple] = {}

        def rows(lang):
            numbers, parts = open_.pop(lang)
            tokens = np.concatenate(parts)
            counts = np.bincount(tokens, minlength=len(numbers))
            shard, words = uuid.uuid4().hex, np.array(list(numbers), object)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            which = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(which[1:], kind="stable") + 1
            found = [part for part in np.split(order, _runs(which[order])[1:]) if len(part)]
            n = len(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard] * (n + 1)), pa.array([lang] * (n + 1)),
                 pa.array([_planes(tokens), *[None] * n], pa.binary()),
                 pa.array([int(counts[1:].sum()), *[None] * n], pa.int64()),
                 pa.array([None, *(int(which[part[0]]) for part in found)], pa.int64()),
                 pa.array([None, *(_packed_words(words[part].tolist(), counts[part], part)
                                   for part in found)], pa.list_(pa.binary()))],
                ["shard", "lang", "tokens", "total", "bucket", "words"])

        for batch in batches:
            for lang, text in zip(values(batch.column("lang")),
                                  values(batch.column("text").cast(pa.binary()))):
                if lang not in open_:
                    open_[lang] = (_Numbers({b"\n": 0}), [])
                numbers, parts = open_[lang]
                found = text.translate(_CLEAN).replace(b"\n", b" \n ").split(b" ")
                found = [numbers[w] for w in found if w]
                found.append(0)
                parts.append(np.array(found, np.uint32))
                if len(parts) % 64 == 0:
                    parts[:] = [np.concatenate(parts)]
                    if len(parts[0]) >= SHARD_TOKENS:
                        yield rows(lang)
        for lang in list(open_):
            yield rows(lang)

    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return stored(texts.mapInArrow(run, _SHARD))


def _vocabulary(shards: DataFrame, buckets: int, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, word, c, id) of the frequent words, (shard, tokens) in their numbers), stored.

    A word's number is made of its bucket and its place among the bucket's frequent words.
    """

    def number(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        langs, of = table.column("lang").to_pylist(), table.column("shard").to_pylist()
        counts: dict[tuple[str, bytes], int] = {}
        parts = [_unpacked_words(x) for x in table.column("words").to_pylist()]
        for lang, (words, c, _) in zip(langs, parts):
            for w, k in zip(words, c.tolist()):
                counts[lang, w] = counts.get((lang, w), 0) + k
        some = sorted(k for k, c in counts.items() if c >= least)
        ids = {k: n * buckets + bucket + 1 for n, k in enumerate(some)}
        told, blobs = [], []
        for lang, shard, (words, _, at) in zip(langs, of, parts):
            new = np.fromiter((ids.get((lang, w), 0) for w in words), np.uint32, len(words))
            hit = new > 0
            if hit.any():
                told.append(shard)
                blobs.append(_packed_known(at[hit], new[hit]))
        n, m = len(some), len(told)
        return pa.table({
            "lang": pa.array([k[0] for k in some] + [None] * m, pa.string()),
            "word": pa.array([k[1] for k in some] + [None] * m, pa.binary()),
            "c": pa.array([counts[k] for k in some] + [None] * m, pa.int64()),
            "id": pa.array([ids[k] for k in some] + [None] * m, pa.int64()),
            "shard": pa.array([None] * n + told, pa.string()),
            "known": pa.array([None] * n + blobs, pa.binary())})

    dealt = shards.where("bucket IS NOT NULL").select("shard", "lang", "bucket", "words")
    found = stored(dealt.groupBy("bucket").applyInArrow(
        number, "lang string, word binary, c long, id long, shard string, known binary"))
    words = found.where("word IS NOT NULL").select("lang", "word", "c", "id")
    known = found.where("shard IS NOT NULL").groupBy("shard").agg(
        F.collect_list("known").alias("known"))

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                tokens = _of_planes(batch.column("tokens")[k].as_py())
                new = np.zeros(int(tokens.max(initial=0)) + 1, np.uint32)
                for blob in batch.column("known")[k].as_py():
                    at, ids = _unpacked_known(blob)
                    new[at] = ids
                out.append(_stream(new[tokens], 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), pa.array(out, pa.list_(pa.binary()))],
                ["shard", "tokens"])

    streams = shards.where("tokens IS NOT NULL").select("shard", "tokens").join(
        known, "shard").mapInArrow(run, "shard string, tokens array<binary>")
    return words, stored(streams)


_FOUND = "shard string, ids array<bigint>, f long, values array<binary>, tokens array<binary>"


def _counted(streams: DataFrame, before: DataFrame | None, n: int, bits: int, lead: int,
             least: int) -> DataFrame:
    """Frequent phrases of ``n`` words (ids, f), and each shard's values of them, stored.

    ``before`` has each shard's values of frequent phrases of one word less. Where there is
    one, the result also has the shards' tokens that are in a counted phrase: longer ones are
    among those.
    """
    shorter, longer, pruned = Permutation(n - 1, bits), Permutation(n, bits), before is not None

    def count(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tokens = _tokens(batch.column("tokens")[k].as_py())
                if len(tokens) < n:
                    continue
                alive = np.lib.stride_tricks.sliding_window_view(tokens > 0, n).all(axis=1)
                at = np.flatnonzero(alive)
                if pruned:
                    known = [np.concatenate([np.frombuffer(x[c], np.uint64) for x in
                                             batch.column("values")[k].as_py()])
                             for c in range(shorter.columns)]
                    # The first phrase of each place, and for the last place the second one.
                    both = np.unique(np.concatenate([at, at + 1]))
                    held = np.zeros(len(tokens) + 1, bool)
                    held[both] = members(known, shorter.values(
                        [tokens[both + j] for j in range(n - 1)]))
                    at = at[held[at] & held[at + 1]]
                if not len(at):
                    continue
                whole = QuotientFilter.of(longer.values([tokens[at + j] for j in range(n)]))
                shard = batch.column("shard")[k].as_py()
                heads, blobs, streams = [], [], []
                if pruned:
                    kept = np.zeros_like(tokens)
                    for j in range(n):
                        kept[at + j] = tokens[at + j]
                    heads.append(xxhash.xxh32_intdigest(shard) >> (32 - lead) if lead else 0)
                    blobs.append(None)
                    streams.append(_stream(kept, n + 1))
                for head, part in whole.parts(lead):
                    heads.append(head)
                    blobs.append(part.encode(longer, lead))
                streams += [None] * (len(heads) - len(streams))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(heads, pa.int64()), pa.array([shard] * len(heads)),
                     pa.array(blobs, pa.list_(pa.binary())), pa.array(streams, pa.list_(pa.binary()))],
                    ["bucket", "shard", "parts", "tokens"])

    def merge(table: pa.Table) -> pa.Table:
        head = table.column("bucket")[0].as_py()
        passed = table.filter(pc.is_valid(table.column("tokens")))
        table = table.filter(pc.is_valid(table.column("parts")))
        shards, found = passed.column("shard").to_pylist(), [None] * passed.num_rows
        f, sent, streams = list(found), list(found), passed.column("tokens").to_pylist()
        filters = [QuotientFilter.decode(p, longer, lead, head)
                   for p in table.column("parts").to_pylist()]
        columns = [np.zeros(0, np.uint64)] * longer.columns
        if filters:
            whole = merged(filters)
            some = whole.counts >= least
            columns = [c[some] for c in whole.columns]
            ids = np.stack(longer.phrases(columns), axis=1).astype(np.int64)
            shards += [None] * len(ids)
            found += list(ids)
            f += whole.counts[some].tolist()
            sent += [None] * len(ids)
        for shard, one in zip(table.column("shard").to_pylist(), filters):
            hit = members(columns, one.columns)
            if hit.any():
                shards.append(shard)
                found.append(None)
                f.append(None)
                sent.append([c[hit].tobytes() for c in one.columns])
        streams += [None] * (len(shards) - len(streams))
        return pa.table({"shard": pa.array(shards, pa.string()),
                         "ids": pa.array(found, pa.list_(pa.int64())), "f": pa.array(f, pa.int64()),
                         "values": pa.array(sent, pa.list_(pa.binary())),
                         "tokens": pa.array(streams, pa.list_(pa.binary()))})

    rows = streams
    if pruned:
        own = before.where("values IS NOT NULL").groupBy("shard").agg(
            F.collect_list("values").alias("values"))
        rows = streams.join(own, "shard").select("shard", "tokens", "values")
    dealt = rows.mapInArrow(count, "bucket long, shard string, parts array<binary>, tokens array<binary>")
    return stored(dealt.groupBy("bucket").applyInArrow(merge, _FOUND))


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST,
                     buckets: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((ids, f) of phrases of one word or more, (lang, word, c, id), (lang, n)), stored.

    ``docs`` has lang and text. Word numbers tell languages apart.
    """
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(partitions, size // BUCKET_BYTES)
    shards = _shards(docs, buckets)
    totals = stored(shards.where("tokens IS NOT NULL").groupBy("lang").agg(
        F.sum("total").alias("n")))
    words, streams = _vocabulary(shards, buckets, least)
    grams = words.select(F.array("id").alias("ids"), F.col("c").alias("f"))
    bits = max(int(words.agg(F.max("id")).first()[0] or 1).bit_length(), 1)
    if bits > 32:
        raise ValueError("more than 2**32 numbers of words")
    lead = min(max(buckets - 1, 1).bit_length(), bits)
    found = None
    for n in range(2, longest + 1):
        found = _counted(streams, found, n, bits, lead, least)
        more = found.where("ids IS NOT NULL").select("ids", "f")
        grams = grams.unionByName(more)
        if not has_rows(more):
            break
        if n > 2:
            streams = found.where("tokens IS NOT NULL").select("shard", "tokens")
    return stored(grams), words, totals


# --- scores --------------------------------------------------------------------------


def phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP,
            covered: int = 100, buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``top`` phrases of each language.

    A phrase is dropped if a longer one holds it and occurs at least ``covered`` times as often
    in a hundred.
    """
    grams, words, totals = frequent_phrases(docs, least=least, longest=longest, buckets=buckets)
    several = grams.where(F.size("ids") > 1)
    # Counts of longer phrases by each shorter one in them.
    inner = grams.where(F.size("ids") > 2).select("f", "ids", F.explode(F.sequence(
        F.lit(2), F.size("ids") - 1)).alias("k"))
    inner = inner.select("f", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("ids") - F.col("k") + 1),
        lambda at: F.slice("ids", at, F.col("k")))).alias("ids"))
    most = inner.groupBy("ids").agg(F.max("f").alias("most"))
    kept = several.join(most, "ids", "left").where(
        F.col("most").isNull() | (100 * F.col("most") < covered * F.col("f")))
    cuts = kept.select("ids", F.col("f").alias("a"), F.explode(F.sequence(
        F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"one": F.slice("ids", 1, F.col("k")),
                             "two": F.slice("ids", F.col("k") + 1, F.size("ids"))})
    for part, name in (("one", "l"), ("two", "r")):
        cuts = cuts.join(grams.select(F.col("ids").alias(part), F.col("f").alias(name)), part)
    langs = words.select("id", "lang").join(totals, "lang")
    cuts = cuts.join(langs, F.col("id") == F.get("ids", F.lit(0)))
    above = F.expr("(1000BD * cast(a as decimal(16,0))) * cast(n as decimal(16,0))")
    below = F.expr("cast(l as decimal(19,0)) * cast(r as decimal(18,0))")
    score = cuts.withColumns({"above": above, "below": below}).withColumn(
        "score", F.expr("above div below"))
    best = score.groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang"))
                                    .alias("best"))
    best = best.select("ids", "best.*")
    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(
        words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.sort_array(F.collect_list(F.struct(
        "at", "word"))).alias("words"))
    text = F.concat_ws(" ", F.transform("words", lambda w: w["word"].cast("string")))
    rows = best.join(spelled.select("ids", text.alias("phrase")), "ids")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


# The same from the definitions: all runs of words as lists.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
found AS (
  SELECT lang, unnest(list_transform(range(0, greatest(len(w) - k + 1, 0)),
    lambda i: w[i + 1:i + k])) AS p
  FROM lists, (SELECT unnest(range(1, 6)) AS k)),
f AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM found GROUP BY 1, 2),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE len(p) = 1 GROUP BY 1),
often AS MATERIALIZED (SELECT lang, p, f AS a FROM f WHERE len(p) > 1 AND f >= 100),
inner_ AS (
  SELECT lang, p[i:i + k - 1] AS p, max(a) AS most
  FROM (SELECT lang, p, a, k, unnest(range(1, len(p) - k + 2)) AS i
        FROM (SELECT lang, p, a, unnest(range(2, len(p))) AS k FROM often WHERE len(p) > 2))
  GROUP BY 1, 2),
kept AS (
  SELECT often.* FROM often LEFT JOIN inner_ USING (lang, p)
  WHERE most IS NULL OR 100 * most < 100 * a),
cuts AS (
  SELECT lang, c.p, a, k, l.f AS l, r.f AS r, n,
    (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM kept) c
  JOIN f l USING (lang) JOIN f r USING (lang) JOIN totals USING (lang)
  WHERE l.p = c.p[1:k] AND r.p = c.p[k + 1:]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS first FROM cuts),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC,
    array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r,
    n::BIGINT AS n, score::BIGINT AS score
  FROM best WHERE first = 1)
SELECT * FROM ranked WHERE rank <= 2000
"""
