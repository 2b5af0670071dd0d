"""Importance resampling towards a target distribution over hashed n-grams of words.

Features of a text are its words and its pairs of neighboring words, joined by one blank; a
feature's bucket is its crc32 modulo ``buckets``. The gain of a bucket is the logarithm of its
smoothed share in the target texts over that in all documents (Xie et al., "Data Selection for
Language Models via Importance Resampling", 2023). A document's weight is the mean gain of its
features; with Gumbel noise from a hash of its id added, the highest scores are a sample
without replacement.

Checksums by a table of positions. crc32 is affine: the checksum of n bytes is the exclusive or
of a constant for n and, for each byte, of a value that depends on the byte and its distance
from the end alone. ``TABLE`` has these values for distances below ``REACH``; a batch looks up
all bytes of its words at once and reduces them with ``bitwise_xor.reduceat`` over the spans of
the features. A pair is the second word's value and the first one's at larger distances. Spans
longer than the table are reduced block by block, and blocks are folded in twos, the left one
moved along by as many zero bytes as follow it.

Counts are sums of at most ``buckets`` rows a task; only those sums come to the driver. Nothing
else is gathered: the order of the drawn documents comes from a range partitioning.

Edges: a null text has no words. Texts without features weigh 0. A null id is drawn as the id
of no digits and ranks after others of equal score. Repeated rows are drawn one by one. Without
target texts all gains come from the documents alone. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored
from .repeats import _Texts

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
REACH = 64
GROUP = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _IN_WORD[_first:_last + 1] = True


def _linear(part: bytes) -> int:
    """Checksum without the constant for the length."""
    return zlib.crc32(part) ^ zlib.crc32(bytes(len(part)))


def _zero_step() -> np.ndarray:
    """What one following zero byte makes of each byte of a value: 4 x 256."""
    unit = np.zeros((4, 256), np.uint32)
    byte = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    byte ^= byte[0]
    unit[0] = byte
    for k in range(1, 4):
        unit[k] = np.arange(256, dtype=np.uint32) << (8 * (k - 1))
    return unit


def _apply(step: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for k in range(4):
        out ^= step[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


# Steps over 1, 2, 4, ... zero bytes, each the one before it taken twice.
STEPS = [_zero_step()]
while len(STEPS) < 40:
    STEPS.append(np.stack([_apply(STEPS[-1], row) for row in STEPS[-1]]))

# Value of each byte at each distance from the end of a span.
TABLE = np.zeros((REACH, 256), np.uint32)
TABLE[0] = [_linear(bytes([b])) for b in range(256)]
for _k in range(1, REACH):
    TABLE[_k] = _apply(STEPS[0], TABLE[_k - 1])


def moved(x: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Values as they are with so many bytes after them."""
    x = x.copy()
    for k in range(int(zeros.max()).bit_length() if len(zeros) else 0):
        at = np.flatnonzero((zeros >> k) & 1)
        x[at] = _apply(STEPS[k], x[at])
    return x


def constants(lengths: np.ndarray) -> np.ndarray:
    """Checksums of so many zero bytes."""
    ones = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    return moved(ones, lengths) ^ np.uint32(0xFFFFFFFF)


def long_span(data: np.ndarray) -> int:
    """Value of one span of any length: blocks of ``REACH`` bytes, folded in twos."""
    blocks = 1 << max(0, (len(data) - 1) // REACH).bit_length()
    padded = np.zeros(blocks * REACH, np.uint8)
    padded[len(padded) - len(data):] = data
    value = np.empty(blocks, np.uint32)
    distance = np.arange(REACH - 1, -1, -1)
    for at in range(0, blocks, GROUP // REACH):
        part = padded[at * REACH:(at + GROUP // REACH) * REACH].reshape(-1, REACH)
        value[at:at + len(part)] = np.bitwise_xor.reduce(TABLE[distance[None, :], part], axis=1)
    step = REACH.bit_length() - 1
    while len(value) > 1:
        value = _apply(STEPS[step], value[0::2]) ^ value[1::2]
        step += 1
    return int(value[0])


class Words:
    """The words of texts laid end to end: lower-cased bytes, starts, ends, number of text."""

    def __init__(self, texts: _Texts):
        self.low = _LOWER[texts.data]
        self.inside = _IN_WORD[self.low]
        full = texts.starts < texts.ends
        first, last = texts.starts[full], texts.ends[full] - 1
        begins, finishes = self.inside.copy(), self.inside.copy()
        begins[1:] &= ~self.inside[:-1]
        finishes[:-1] &= ~self.inside[1:]
        begins[first], finishes[last] = self.inside[first], self.inside[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        self.text = texts.of(self.starts)

    def groups(self):
        """Ranges of words of about ``GROUP`` bytes."""
        at = 0
        while at < len(self.starts):
            stop = int(np.searchsorted(self.ends, self.starts[at] + GROUP, "right"))
            stop = max(stop, at + 1)
            yield at, stop
            at = stop

    def values(self, at: int, stop: int, beyond: np.ndarray) -> np.ndarray:
        """Value of each word of a range, with ``beyond`` bytes after it; 0 where too long."""
        lo, hi = int(self.starts[at]), int(self.ends[stop - 1])
        size = self.ends[at:stop] - self.starts[at:stop]
        out = np.zeros(stop - at, np.uint32)
        fit = size + beyond <= REACH
        if not fit.any():
            return out
        place = np.flatnonzero(self.inside[lo:hi])
        number = np.repeat(np.arange(stop - at), size)
        if not fit.all():
            keep = fit[number]
            place, number = place[keep], number[keep]
        distance = (self.ends[at:stop] - 1 - lo + beyond)[number] - place
        each = TABLE[distance, self.low[lo:hi][place]]
        begin = np.cumsum(size[fit]) - size[fit]
        out[fit] = np.bitwise_xor.reduceat(each, begin)
        return out


def feature_hashes(texts: _Texts):
    """(words by text, numbers of the texts of features, checksums of features), in groups."""
    words = Words(texts)
    counts = np.bincount(words.text, minlength=len(texts.starts))
    return counts, _hashes(words)


def _hashes(words: Words):
    for at, stop in words.groups():
        # One word more, so that its pair with the last one is found here.
        stop_next = min(stop + 1, len(words.starts))
        size = words.ends[at:stop_next] - words.starts[at:stop_next]
        value = words.values(at, stop_next, np.zeros(stop_next - at, np.int64))
        for k in np.flatnonzero(size > REACH):
            value[k] = long_span(words.low[words.starts[at + k]:words.ends[at + k]])
        n = stop - at
        yield words.text[at:stop], value[:n] ^ constants(size[:n])
        text = words.text[at:stop_next]
        pair = np.flatnonzero(text[1:] == text[:-1])
        if not len(pair):
            continue
        after = np.zeros(stop_next - at, np.int64)
        after[pair] = size[pair + 1] + 1
        both = size[pair] + after[pair]
        first = words.values(at, stop_next, after)[pair]
        far = both > REACH
        blank = np.full(len(pair), TABLE[0][32], np.uint32)
        near = ~far
        blank[near] = TABLE[size[pair + 1][near], 32]
        if far.any():
            first[far] = moved(value[pair[far]], after[pair[far]])
            blank[far] = moved(blank[far], size[pair[far] + 1])
        yield text[pair], first ^ blank ^ value[pair + 1] ^ constants(both)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, hashes in feature_hashes(_Texts(batch.column(0)))[1]:
                total += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    rows = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(
        F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.k] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, for each bucket."""
    n = len(source)
    above = (target + 1.0) * (source.sum() + float(n))
    below = (source + 1.0) * (target.sum() + float(n))
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs`` (doc_id, text)."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            texts = _Texts(batch.column("text"))
            words, groups = feature_hashes(texts)
            total = np.zeros(len(words), np.int64)
            for text, hashes in groups:
                # Texts come in order: one sum for each run of features of one text.
                start = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                np.add.at(total, text[start], np.add.reduceat(
                    gain[hashes % np.uint32(buckets)], start))
            features = np.maximum(2 * words - 1, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(features),
                 pa.array(total // np.maximum(features, 1))],
                ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED
             ) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text).

    ``target`` has the texts of the target distribution. ``rank`` is null for documents that
    are not drawn: those of fewer than ``least_words`` words, and all but ``percent`` of a
    hundred of the others.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = weights(docs, gain)
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(own, 256), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stored(rows.withColumn("score", F.col("weight") + noise))
    fit = rows.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"),
             F.col("n_words")]
    ranked = numbered(fit, *order)
    rank = F.when(F.col("number") < drawn, F.col("number") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = rows.where(F.col("n_words") < least_words).select(
        *columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.cast("long").alias("rank")).unionByName(rest)


# The same from the definitions; checksums by the values of bytes at distances from the end.
SQL = r"""
WITH RECURSIVE bits(b, v, k) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1
  FROM bits WHERE k < 8),
step AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),
lists AS MATERIALIZED (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
uses AS MATERIALIZED (
  SELECT kind, id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM lists),
features AS MATERIALIZED (
  SELECT feature, hex(feature) AS h, length(hex(feature)) // 2 AS size
  FROM (SELECT DISTINCT feature FROM uses)),
values_(b, d, v) AS (
  SELECT b, 0, v FROM step
  UNION ALL
  SELECT x.b, d + 1, xor(x.v >> 8, s.v) FROM values_ x JOIN step s ON s.b = x.v % 256
  WHERE d + 1 < (SELECT max(size) FROM features)),
zeros(n, v) AS (
  SELECT 0, 4294967295::BIGINT
  UNION ALL
  SELECT n + 1, xor(z.v >> 8, s.v) FROM zeros z JOIN step s ON s.b = z.v % 256
  WHERE n < (SELECT max(size) FROM features)),
bytes AS (
  SELECT feature, size, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT AS b, size - 1 - i AS d
  FROM (SELECT *, unnest(range(size)) AS i FROM features)),
hashed AS MATERIALIZED (
  SELECT feature, xor(xor(bit_xor(x.v), any_value(z.v)), 4294967295) % 10000 AS k
  FROM bytes JOIN values_ x USING (b, d) JOIN zeros z ON z.n = size GROUP BY feature),
counts AS (
  SELECT k, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t
  FROM uses JOIN hashed USING (feature) GROUP BY k),
gains AS (
  SELECT k, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts),
sums AS (
  SELECT id, sum(gain) AS total, count(*) AS n FROM uses JOIN hashed USING (feature)
  JOIN gains USING (k) WHERE kind = 0 GROUP BY id),
scored AS (
  SELECT l.id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
    coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || l.id), 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM lists l LEFT JOIN sums s ON s.id = l.id WHERE kind = 0),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN rank <= (SELECT count(*) * 25 // 100 FROM ranked) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
