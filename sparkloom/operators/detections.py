"""Frame batches and object detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_frames(frames: DataFrame, index: str, size: int = 5) -> DataFrame:
    """Batches of ``size`` consecutive frames with their bounds."""
    return frames.groupBy(F.floor(F.col(index) / size).alias("batch_id")).agg(
        F.min(index).alias("start_frame"), F.max(index).alias("end_frame"), F.count("*").alias("n_frames"))


def detection_counts(detections: DataFrame, confident: float = 0.5) -> DataFrame:
    """Kept detections per frame, per batch and per class: three grains in one pass by grouping sets."""
    kept = detections.where(F.col("confidence") > confident)
    out = kept.groupingSets([["frame_id"], ["batch_id"], ["class"]], "frame_id", "batch_id", "class").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.grouping_id().alias("g"))
    grain = F.when(F.col("g") == 3, "frame").when(F.col("g") == 5, "batch").otherwise("class")
    return out.withColumn("grain", grain).drop("g")


def detection_summary(counts: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent classes over all batches."""
    per_class = counts.where(F.col("grain") == "class").groupBy("class").agg(F.sum("n").alias("n"))
    return per_class.orderBy(F.desc("n"), F.asc("class")).limit(k)
