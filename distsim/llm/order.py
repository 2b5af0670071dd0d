"""Training order: fixed-stride shards of token ids in a keyed random order.

Documents become one stream of token ids for each input partition: the UTF-8 bytes of a
text (byte-level ids, one byte each), then ``END``. The stream is cut into sequences of
``length`` ids; the last one of a partition is filled with ``PAD``. Neither mark occurs in
UTF-8. Counts of bytes per partition, one number each, give every sequence a global index.

A Feistel network with a key is a bijection on an even number of bits; walking its cycle
until the value is below the number of sequences makes it a permutation of the indexes
(Black and Rogaway, "Ciphers with Arbitrary Finite Domains", 2002). So each sequence's slot
in training order follows from its index and the key alone: no sort, no table of the order.

A shard is a range of ``shard_rows`` slots. All sequences of a shard meet in one task, which
writes them in order as one plain file of records of ``length`` + 1 bytes (the ids and a line
end). Record k of shard s is slot s * shard_rows + k, at byte k * (length + 1), so a reader
starts or resumes at any slot. Files are written by Spark's own writer with its commit
protocol, so a lost executor leaves no partial shard.

The input should come from stored files, whose partitions are the same each time they are
read. Edges: a null text is an empty one. Repeated rows are repeated in the stream. An empty
table has no sequences and no shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 2048
SHARD_ROWS = 4096
KEY = 0x5EED
ROUNDS = 4
END, PAD = b"\xff", b"\xfe"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A well-mixed 64-bit function of x and the key."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each index below ``n``; inverse-free, a permutation for every key."""
    if n <= 1:
        return index.astype(np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")
            for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def sequences(docs: DataFrame, *, length: int = LENGTH, key: int = KEY,
              shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(sequence, slot, shard, doc_ids, ids) of ``docs`` (doc_id, text), and their number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    sums = {r.p: r.n for r in rows.select(F.spark_partition_id().alias("p"), size.alias("n"))
            .groupBy("p").agg(F.sum("n").alias("n")).collect()}
    first, total = {}, 0
    for p in sorted(sums):
        first[p] = total
        total += -(-sums[p] // length)

    def cut(batches):
        at = first.get(TaskContext.get().partitionId())
        stream, ids, starts = b"", [], []

        def rows_of(n: int):
            """The first n sequences held."""
            if at is None:
                raise ValueError("rows changed partitions between two passes; store them first")
            begin = np.array(starts, np.int64)
            edges = np.arange(n, dtype=np.int64) * length
            lo = np.searchsorted(begin, edges, "right") - 1
            hi = np.searchsorted(begin, edges + length - 1, "right")
            index = np.arange(at, at + n, dtype=np.int64)
            slot = permute(index, total, key)
            return pa.RecordBatch.from_arrays(
                [pa.array(index), pa.array(slot), pa.array(slot // shard_rows),
                 pa.array([ids[a:b] for a, b in zip(lo, hi)], pa.list_(pa.int64())),
                 pa.array([stream[k:k + length] for k in edges.tolist()], pa.binary())],
                ["sequence", "slot", "shard", "doc_ids", "ids"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            parts, held = [stream], len(stream)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids.append(doc_id)
                starts.append(held)
                parts += [text or b"", END]
                held += len(text or b"") + 1
            stream = b"".join(parts)
            if n := len(stream) // length:
                yield rows_of(n)
                at += n
                stream = stream[n * length:]
                keep = max(0, int(np.searchsorted(starts, n * length, "right")) - 1)
                ids, starts = ids[keep:], [s - n * length for s in starts[keep:]]
        if stream:
            stream = stream.ljust(length, PAD)
            yield rows_of(1)

    found = rows.mapInArrow(
        cut, "sequence long, slot long, shard long, doc_ids array<long>, ids binary")
    return found, total


def write_shards(found: DataFrame, total: int, path: str, *, shard_rows: int = SHARD_ROWS
                 ) -> None:
    """Write the shards below ``path``, one file in a folder ``shard=<number>`` each."""
    shards = max(1, -(-total // shard_rows))
    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.select("shard", "slot", F.col("ids").cast("string").alias("value"))
    rows = rows.repartitionByRange(min(shards, 4 * partitions), "shard")
    rows.sortWithinPartitions("shard", "slot").select("shard", "value").write.partitionBy(
        "shard").text(path)


def read_slots(spark: SparkSession, path: str, first: int, count: int, *, length: int = LENGTH,
               shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(slot, ids) of ``count`` slots from ``first`` on, by position in the shards."""
    numbers = range(first // shard_rows, (first + max(count, 1) - 1) // shard_rows + 1)
    files = spark.read.format("binaryFile").load([f"{path}/shard={k}" for k in numbers])
    shard = F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long").alias("shard")
    stride = length + 1

    def cut(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = shard * shard_rows
                lo = max(first - base, 0)
                hi = min(first + count - base, len(content) // stride)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(base + lo, base + hi), pa.int64()),
                     pa.array([content[k * stride:k * stride + length]
                               for k in range(lo, hi)], pa.binary())], ["slot", "ids"])

    return files.select(shard, "content").mapInArrow(cut, "slot long, ids binary")


def training_order(docs: DataFrame, path: str, *, length: int = LENGTH, key: int = KEY,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the shards of ``docs`` below ``path``; where each sequence is, and its digest."""
    found, total = sequences(docs, length=length, key=key, shard_rows=shard_rows)
    if total:
        write_shards(found, total, path, shard_rows=shard_rows)
    return found.select(
        "sequence", "slot", "shard", ((F.col("slot") % shard_rows) * (length + 1)).alias("byte"),
        "doc_ids", F.sha2("ids", 256).alias("ids_sha256"))
