"""Cutting lineage of iterative jobs so that they survive executor loss."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def _ensure_dir(df: DataFrame) -> None:
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder of ``spark.checkpoint.dir``.

    Only when that setting is absent (tests on one machine) a scratch folder is used.

    A checkpoint hands on the planner's estimate of its size, and that of a join is the product of its sides: over rounds
    of joins it becomes a number of gigabytes that the driver multiplies.  So the rows are held while they are
    written, and the checkpoint has the size that was measured.
    """
    _ensure_dir(df)
    if not eager:
        return df.checkpoint(eager=False)
    held = df.select("*").persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    out = held.select("*").checkpoint()
    held.unpersist()
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the files of rounds that nothing refers to any more; otherwise they stay until the driver is short of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def known_partitions(spark: SparkSession) -> Iterator[None]:
    """Plans made in this block tell how their rows are dealt, and so do tables that are stored from them.

    Adaptive plans do not, and a table stored from one is dealt anew by every join of every round.
    """
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
