"""The registered query of every operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from . import oracles
from ._shared import query


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_line_dedup", oracles.LINES)
def op1(spark: SparkSession, d: str) -> DataFrame:
    from .lines import dedup

    return dedup(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_ann")
def op2(spark: SparkSession, d: str) -> DataFrame:
    from .ann import search

    return search(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op3_urls")
def op3(spark: SparkSession, d: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("block_probability", 6).alias("block_probability"))


@query("op4_decontamination", oracles.DECONTAMINATION)
def op4(spark: SparkSession, d: str) -> DataFrame:
    from .decontaminate import scan

    found = scan(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


@query("op5_quality")
def op5(spark: SparkSession, d: str) -> DataFrame:
    from .quality import fit, judge

    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    return judge(docs, fit(docs, table(spark, d, "labels"))).select(
        "doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), "rejected")


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op6_secrets", oracles.SECRETS)
def op6(spark: SparkSession, d: str) -> DataFrame:
    from .secrets import scan

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "owned")
    count = lambda test: F.size(F.filter(spans, test)).cast("long")
    return scan(table(spark, d, "documents")).select(
        "doc_id", count(lambda s: s["kind"] == "assign").alias("n_assign"), count(lambda s: s["kind"] == "access").alias("n_access"),
        count(lambda s: s["kind"] == "hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "example").alias("n_example"))


@query("op7_packing")
def op7(spark: SparkSession, d: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, d, "documents"), byte_bpe_path(), end_id=1, length=2048, with_ids=False)


@query("op8_minhash", oracles.NEAR_DUPLICATES)
def op8(spark: SparkSession, d: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, d, "documents"))


@query("op9_repeats")
def op9(spark: SparkSession, d: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, d, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_warc", oracles.WARC)
def op10(spark: SparkSession, d: str) -> DataFrame:
    from .warc import read_archives, write_archives

    records = read_archives(write_archives(table(spark, d, "pages")))
    payload = F.col("payload")
    return records.select(
        F.col("record_id").try_cast("long").alias("page_id"),
        F.when(payload.isNull(), F.col("payload_length")).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(payload.isNull(), F.col("payload_digest")).otherwise(F.sha1(payload)).alias("payload_digest"),
        "record_type", F.col("refers_to").try_cast("long").alias("refers_to"))


@query("op11_grouping")
def op11(spark: SparkSession, d: str) -> DataFrame:
    from .grouping import pack_documents

    return pack_documents(table(spark, d, "documents"), byte_bpe_path(), end_id=0, length=2048, with_ids=False)


@query("op12_resampling", oracles.RESAMPLING)
def op12(spark: SparkSession, d: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, d, "documents"), table(spark, d, "benchmark"), n=1, buckets=10_000, percent=10, min_words=20, seed="2024").select(
        "doc_id", "n_features", "weight", "score", "rank")


@query("op13_whitening")
def op13(spark: SparkSession, d: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, d, "embeddings"), components=32)
