"""Partitioned stores, document tables, run files and messages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.wordcount import reducer_of


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location (a scratch one only in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/" + name


def write_partitioned(df: DataFrame, path: str, n: int, word: str = "word") -> None:
    """Write words into one directory per reducer.

    Rows are dealt by (reducer, word), so a hot reducer is written by all tasks; the number of tasks is the
    session's and is merged by the size of the data.
    """
    df.withColumn("reducer", reducer_of(F.col(word), n)).repartition("reducer", word).write.mode("overwrite").partitionBy("reducer").parquet(path)


def list_partitions(df: DataFrame, column: str = "reducer") -> DataFrame:
    """The partitions of a stored table: their names come from its folders, no data column is read."""
    return df.select(column).distinct()


def read_partition(spark: SparkSession, path: str, reducer: int) -> DataFrame:
    """One partition; the filter prunes directories."""
    return spark.read.parquet(path).where(F.col("reducer") == reducer)


def publish_posts(df: DataFrame, path: str) -> None:
    """Append nested post records."""
    df.write.mode("append").parquet(path)


def to_messages(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_runs(df: DataFrame, path: str, workflow: Column, config: Column) -> None:
    """Run records in one pass, in a folder ``workflow__config.json`` for each configuration."""
    df.withColumn("run", F.concat(workflow, F.lit("__"), config, F.lit(".json"))).write.partitionBy("run").json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Run records; workflow and configuration come from the ``workflow__config.json`` file name."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/=]+)\.json", 1)
    parts = F.split(stem, "__")
    return spark.read.schema(schema).json(path).withColumn("workflow", parts[0]).withColumn("config", parts[1])


def combine_runs(scenario: str, *results: DataFrame) -> DataFrame:
    """Merge result tables of the same scenario: run counts and totals over all files."""
    merged = results[0]
    for other in results[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy(scenario).agg(F.sum("runs").alias("runs"), F.sum("total_ms").alias("total_ms"),
                                        F.max("max_ms").alias("max_ms"))
