"""Five stages that turn ``documents`` into packed training sequences.

Every stage is ``(name, function)`` with ``function(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's ``docs``.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, lines, minhash, packing, quality
from sparkloom.llm._shared import scratch
from sparkloom.llm.queries import byte_bpe_path
from sparkloom.plans.tables import table


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later repeated runs of three lines or of 50 words; a document that loses all its lines goes."""
    return _counted(lines.dedup(docs, drop_emptied=True, words=50).select(*docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, linked at similarity 0.80 or more.

    15 x 15 bands of 3 minhashes miss 0.004 % of the pairs at 0.80.
    """
    return minhash.drop_near_duplicates(docs, percent=80, halves=15)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts."""
    return _counted(decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), how="spans"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 ids."""
    return packing.pack_documents(docs, byte_bpe_path(), end_id=1, length=2048, with_ids=False)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_dedup_stage), ("minhash near-dedup", near_dedup_stage),
          ("benchmark decontamination", decontamination_stage), ("packing", packing_stage)]

#: The classifier's fit and the tokenizer are not SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
