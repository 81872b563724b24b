"""What the operators of this subpackage share: tables, checkpoints, bounded bitmaps."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap that goes to every executor: 4 MB, whatever the input's size.
BITMAP_BITS = 1 << 25


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of few megabytes, whatever the texts' lengths: what a Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thrifty(run):
    """A function for mapInArrow that gives its worker's freed memory back when a task ends: workers live on, and so does what they hold."""

    def thrifty_run(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return thrifty_run


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; only where that is unset and all runs on one machine a temporary one is made."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read back."""
    limit_batches(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def lent(spark: SparkSession, value) -> Iterator[Broadcast]:
    """A broadcast of value for what is written inside the block; afterwards nothing keeps it."""
    given = spark.sparkContext.broadcast(value)
    try:
        yield given
    finally:
        given.destroy()


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


#: Rows of a small join side that are sent to every executor, at most.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """A side of a join, of a few numbers a row: broadcast if its checked size allows, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def bit_of(column: Column) -> Column:
    """The bitmap position of a hashed BIGINT column."""
    return column.bitwiseAND(F.lit(BITMAP_BITS - 1).cast("bigint"))


def bitmap(df: DataFrame, position: Column) -> np.ndarray:
    """The set of positions in df as a bit array of BITMAP_BITS bits, at most 1024 rows of 4 KB on the driver.

    Used as a one-sided filter: a set bit may be a collision, a clear bit never hides a member, so
    callers repeat the exact join on what passes. A full bitmap only costs that saving.
    """
    rows = (
        df.select((position + 1).alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        .collect()
    )
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in rows:
        start = (row["bucket"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def in_bitmap(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Which positions are set."""
    p = positions.astype(np.int64)
    return ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
