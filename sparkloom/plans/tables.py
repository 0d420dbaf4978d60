"""Reading the input tables and pinning the few session settings results depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table; column pruning and filter push-down reach the scan."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def colocate(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows by a key once, before they are multiplied.

    Every later aggregation, window or join whose keys start with these ones finds its rows in place
    and needs no exchange of its own.  Meant for unique or near-unique keys (documents, sequences),
    where it moves each text once instead of moving its word counts several times.  A table bucketed
    by the key needs no call.

    The number of partitions is given, because Spark would join small ones by the bytes that are moved, which tell
    nothing about rows that grow manifold afterwards.
    """
    return df.repartition(_parts(df.sparkSession), *[F.col(k) for k in keys])


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def deal(df: DataFrame) -> DataFrame:
    """Deal rows that are small but take long over all partitions, one after the other.

    ``colocate`` does nothing to rows that an aggregation has placed by the same key, and such partitions are joined by their bytes.
    """
    return df.repartition(_parts(df.sparkSession))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the scan has fewer splits than the cluster has slots.

    A scan of large files already has more splits than slots and is returned untouched, so at
    scale this adds no shuffle; one small file would otherwise run a heavy expression in one task.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)
