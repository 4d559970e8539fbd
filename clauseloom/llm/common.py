"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def give_back() -> None:
    """Returns the process's freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run):
    """A function for mapInArrow whose worker gives its memory back once a task's rows
    are out: workers are kept for later tasks, also those of other stages."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. On one machine, as in
    tests, a temporary folder is set for the session where it is unset; a cluster
    must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="clauseloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back,
    so that a lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(left: DataFrame, right: DataFrame, on: str, spread: Column, n: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join of a large, possibly skewed ``left`` with a smaller ``right``
    of unique keys: a hot key of ``left`` is dealt over ``n`` tasks by
    ``spread``, and each row of ``right`` is repeated for each of them."""
    salt = "_salt"
    left = left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(n)))
    right = right.withColumn(salt, F.explode(F.expr(f"sequence(0L, {n - 1}L)")))
    return left.join(right, [on, salt], how).drop(salt)


#: Most rows of a key table that are broadcast; beyond, joins with it shuffle.
BROADCAST_ROWS = 500_000


def checked_broadcast(keys: DataFrame) -> DataFrame:
    """``keys``, a written table of short rows, marked for broadcast if it is small enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def prefix_offsets(counts: DataFrame, within: list[str], bucket: str, size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the earlier buckets of the same
    ``within``. The table has one row per bucket, so the window is small."""
    from pyspark.sql import Window

    w = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)))
