"""What the operators share: table reads, reserved names, lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.session import cut_lineage, ensure_checkpoint_dir

#: White space as ``str.isspace``-free classes: ASCII (word rules of the quality and near-dup operators)
ASCII_WORD = r"[^\x20\x09-\x0D]+"


#: rows of an Arrow batch between JVM and Python; texts may be long, and a batch is held on both sides
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``ARROW_ROWS`` rows if it is larger (or unlimited)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names.

    Operators work on these and join their results back, so extra columns of
    the caller can carry any name without a clash.
    """
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


@contextlib.contextmanager
def _own_shuffles(spark: SparkSession):
    """Plans made here are run once: their shuffle files go when they have ended, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read on from there."""
    with _own_shuffles(df.sparkSession):
        return cut_lineage(df.select("*"))


def store(df: DataFrame) -> DataFrame:
    """:func:`settle` as Parquet, for tables of plain columns: half the bytes and less of a checkpoint's rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with _own_shuffles(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: rows of ids and hashes that one task takes (a few MB)
TASK_ROWS = 200_000


def sized(df: DataFrame, rows: int, a_task: int = TASK_ROWS) -> DataFrame:
    """``df`` in as many partitions as its counted ``rows`` need, never more than it has.

    Every map task of a shuffle writes files of its own, so a small table that
    lies in many partitions costs far more disk than it has bytes.
    """
    return df.coalesce(max(1, -(-int(rows) // a_task)))


def compact(df: DataFrame, a_task: int = TASK_ROWS) -> DataFrame:
    """:func:`settle`, then :func:`sized` by the count of what was written."""
    out = settle(df)
    return sized(out, out.count(), a_task)


#: a table goes to every executor only if it was counted and has no more rows and list entries than these (20 to 40 MB)
BROADCAST_ROWS, BROADCAST_ENTRIES = 300_000, 1_000_000


def broadcast_if_small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """``df``, written out by the caller, marked for broadcast if it is small; else joins shuffle the other side to it."""
    entries = F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0)
    size = df.agg(F.count(F.lit(1)).alias("n"), entries.alias("k")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and size["k"] <= BROADCAST_ENTRIES else df


def same(a, b):
    """Null-safe equality, usable as a hash-join key."""
    return a.eqNullSafe(b)


def buckets_for(n: int, per_bucket: int, least: int = 1) -> int:
    """Number of buckets so that each holds about ``per_bucket`` units; grows with ``n``."""
    return max(least, -(-int(n) // per_bucket))


def release() -> None:
    """Give freed memory of this worker back to the system (glibc keeps freed blocks; elsewhere nothing happens)."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run):
    """A batch function that releases memory when its task's input ends, as workers are used again by later stages."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return wrapped


def numbers(column: pd.Series) -> pd.Series:
    """Whole numbers that came as text (pandas would turn those beside nulls into doubles) as a nullable column."""
    return pd.Series([None if x is None else int(x) for x in column], dtype="Int64")
