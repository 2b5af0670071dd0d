"""Shared pieces: words, folds by checksum, stored intermediate tables, global numbering."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship  # noqa: F401

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
# Tables of at most this many rows, counted first, may be broadcast.
SMALL_ROWS = 100_000


def words(text: Column) -> Column:
    """Array of the ``[^\\x20\\x09-\\x0D]+`` words of a text; empty for null."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed != "", F.split(trimmed, WHITE_RUN)).otherwise(
        F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def in_fold(doc_id: Column, folds: int, number: int) -> Column:
    """Whether the id falls in the fold; false for a null id."""
    return F.coalesce(fold(doc_id, folds) == number, F.lit(False))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The folder is ``spark.checkpoint.dir``; only if that is unset, one below the warehouse,
    which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder, and read again.

    A lost executor costs nothing that is stored. The files stay until the application's
    owner clears the folder.
    """
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return the memory a worker has freed to the system, where the C library can.

    Workers outlive their tasks, and what one task used would count against the next.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def values(array, rows: int = 500) -> Iterator:
    """Values of an Arrow array, made Python objects a few rows at a time."""
    for at in range(0, len(array), rows):
        yield from array.slice(at, rows).to_pylist()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has one of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all other columns under names of no meaning, and what gives them back.

    Operators that add columns can so work on tables that have columns of those names.
    """
    names = {c: f"kept_{k}" for k, c in enumerate(df.columns) if c not in used}
    rows = df.select(*used, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])

    def restored(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(names.get(c, c)).alias(c) for c in df.columns])

    return rows, restored


def has_rows(df: DataFrame) -> bool:
    return len(df.take(1)) > 0


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have few rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """``df`` with a gapless number from 0 in the given order, stored.

    Rows are range-partitioned and sorted; each gets its position in its partition, and
    the partitions' row counts (one number per partition) are turned into offsets. No
    task sees more than its range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    counts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
              .collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    table = df.sparkSession.createDataFrame(offsets, "__part long, __first long")
    joined = rows.join(F.broadcast(table), part == F.col("__part"))
    number = F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*df.columns, number.alias(name))
