"""Word count with visible reducers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whitespace_words


def words(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per whitespace-separated word, with its position."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(whitespace_words(F.col(text))).alias("pos", "word"))


def reducer_of(word: Column, n: int) -> Column:
    """sha256(word) read as one big integer, modulo ``n``: eight 32-bit steps, no wide integers."""
    h = F.sha2(word, 256)
    acc = F.lit(0).cast("long")
    for i in range(8):
        chunk = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        acc = (acc * F.lit(1 << 32) + chunk) % n
    return acc


def assign_reducer(df: DataFrame, word: str = "word", n: int = 3) -> DataFrame:
    return df.withColumn("reducer", reducer_of(F.col(word), n))


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts per word; partial aggregation is the map-side combiner, also for a hot word."""
    exploded = df.select(F.explode(whitespace_words(F.col(text))).alias("word"))
    return exploded.groupBy("word").agg(F.count("*").alias("n"))


def word_count_map(counts: DataFrame, reducers: int = 3, buckets: int = 64) -> DataFrame:
    """Union of the reducers' key-disjoint maps as rows of bounded maps.

    ``buckets`` sets how finely a reducer's vocabulary is cut, so that no map (and no task)
    has to hold a whole vocabulary; every word is in exactly one map.
    """
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % buckets
    return (
        counts.withColumn("reducer", reducer_of(F.col("word"), reducers))
        .withColumn("bucket", bucket)
        .groupBy("reducer", "bucket")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "n")))).alias("counts"))
    )
