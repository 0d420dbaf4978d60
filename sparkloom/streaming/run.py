"""Running a stream over the data present and reading back what it wrote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder


def read_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table's file as a stream, with the schema of the stored table."""
    path = f"{directory.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a glob is accepted for a single file as well as for a folder of part files
    return spark.readStream.schema(schema).parquet(path[:-1] + "[t]")


def drain(result: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available, writing to the shared folder, and return the written rows.

    Batches are written under their batch number, so a replayed batch replaces itself.
    """
    spark = result.sparkSession
    base = shared_folder(spark, "stream")

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    q = (result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    return spark.read.schema(result.schema.add("batch", "long")).parquet(f"{base}/out")


def latest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final state of an update-mode stream: the newest batch per key."""
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")
