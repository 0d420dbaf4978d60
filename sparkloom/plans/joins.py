"""Joins with a checked broadcast side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Size estimate of the optimised plan (file sizes for scans); reads nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str] | str, how: str = "left",
                limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Join a lookup table: broadcast while its estimated size is below ``limit``, shuffled beyond it."""
    side = F.broadcast(lookup) if estimated_bytes(lookup) <= limit else lookup
    return df.join(side, on, how)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result to every row, as a scalar subquery (no join).

    The subquery fails when it has more than one row, so nothing unbounded can slip in.
    """
    row = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    return df.withColumn("__row", row).select("*", "__row.*").drop("__row")


def join_spread(df: DataFrame, lookup: DataFrame, key: str, salt: str, how: str = "inner", rows_per_part: int = 100_000) -> DataFrame:
    """Join one lookup row for each key to rows of which a few keys may hold most.

    Keys with more than ``rows_per_part`` rows are split into parts by a hash of ``salt`` and only their lookup rows
    are repeated, so no task meets a whole hot key.  There are at most rows / rows_per_part such keys; that
    bound makes their table small.  ``df`` is read twice and should be stored or cheap.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > rows_per_part)
    hot = counted.select(key, F.ceil(F.col("__c") / rows_per_part).cast("int").alias("__parts"))
    one = F.coalesce("__parts", F.lit(1))
    left = df.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.hash(salt), one)).drop("__parts")
    right = lookup.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), one - 1))).drop("__parts")
    return left.join(right, [key, "__part"], how).drop("__part")
