"""Tokens, tags, n-grams and vocabulary of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.ordered import top_k
from .phrases import cooccurrence, ngrams  # noqa: F401


def tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, token)``; the scan, the split and the explode stay in one stage."""
    return df.select(key, F.posexplode(T.word_array(F.col(text))).alias("pos", "token"))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sent_idx, sentence, n_tokens)``; numbering happens in the row, without a window."""
    s = df.select(key, F.posexplode(T.sentence_array(F.col(text))).alias("sent_idx", "sentence"))
    return s.withColumn("n_tokens", F.size(T.word_array(F.col("sentence"))))


def pos_tag(toks: DataFrame) -> DataFrame:
    return toks.withColumn("tag", T.tag(F.col("token")))


def pos_distribution(tags: DataFrame, key: str = "doc_id") -> DataFrame:
    return tags.groupBy(key, "tag").agg(F.count("*").alias("n"))


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lower-cased word counts per document, straight from the text."""
    return (
        df.select(key, F.explode(T.word_array(F.col(text))).alias("token"))
        .groupBy(key, F.lower("token").alias("word")).agg(F.count("*").alias("freq"))
    )


def vocab_stats(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    out = counts.groupBy(key).agg(
        F.sum("freq").alias("total_words"), F.count("*").alias("vocab_size"),
        F.count_if(F.col("freq") == 1).alias("hapax_count"),
    )
    return out.withColumn("ttr", F.col("vocab_size") / F.greatest("total_words", F.lit(1)))


def zipf(counts: DataFrame, k: int | None = 50, key: str = "doc_id") -> DataFrame:
    """Rank, frequency, expected frequency and deviation of the most frequent words."""
    ranked = top_k(counts, [key], [F.desc("freq"), F.asc("word")], k, "zipf_rank")
    first = F.first("freq").over(Window.partitionBy(key).orderBy("zipf_rank"))
    out = ranked.withColumn("expected", first / F.col("zipf_rank"))
    gap = F.abs(F.col("freq") - F.col("expected")) / F.greatest(F.col("expected"), F.lit(1.0))
    return out.withColumn("deviation", gap)


def length_hist(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    return counts.groupBy(key, F.length("word").alias("len")).agg(F.sum("freq").alias("n"))


def sent_word_counts(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentence x word counts of every sentence of a document."""
    words = F.explode(T.word_array(F.lower(F.col("sentence"))))
    return (
        sents.select(key, "sent_idx", words.alias("word"))
        .groupBy(key, "sent_idx", "word").agg(F.count("*").alias("n"))
    )
