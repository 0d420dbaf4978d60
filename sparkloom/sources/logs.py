"""Reading function log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "ts_ms long, seq long, log_group string, message string"


def read_logs(spark: SparkSession, path: str, since_ms: int = 0) -> DataFrame:
    """Log lines since a start time.  Parquet logs prune row groups by the pushed predicate."""
    return spark.read.schema(LOG_SCHEMA).parquet(path).where(F.col("ts_ms") >= since_ms)
