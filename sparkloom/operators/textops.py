"""Posts, mentions, links, short codes and the small text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import ANY_WORD, find_all
from ..plans.ordered import top_k


def mentions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(find_all(F.col(text), L.MENTION_PATTERN, 1)).alias("pos", "name"))


def find_urls(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(find_all(F.col(text), L.URL_PATTERN)).alias("pos", "url"))


def short_code(url: Column) -> Column:
    """Five lowercase letters from the digest of the address."""
    return F.translate(F.substring(F.md5(url), 1, 5), "0123456789abcdef", "abcdefghijklmnop")


def shorten(df: DataFrame, url: str = "url") -> DataFrame:
    """Distinct addresses with deterministic short ones; equal codes get a running suffix."""
    distinct = df.select(F.col(url).alias("url")).distinct().withColumn("code", short_code(F.col("url")))
    n = F.row_number().over(Window.partitionBy("code").orderBy("url"))
    suffix = F.when(n > 1, n.cast("string")).otherwise("")
    return distinct.select("url", F.concat(F.lit(L.SHORT_HOST + "/"), "code", suffix).alias("short"))


def create_posts(names: DataFrame, urls: DataFrame, key: str) -> DataFrame:
    """Post record per key from the two branches; either may be missing."""
    left = names.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("user_names")
    )
    right = urls.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "url", "short"))),
                    lambda s: F.struct(s["url"].alias("url"), s["short"].alias("short"))).alias("urls")
    )
    return left.join(right, key, "full_outer")


def simple_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Lower-cased Unicode words inside the row, with their number."""
    words = find_all(F.lower(F.col(text)), ANY_WORD)
    return df.withColumn("words", words).withColumn("count", F.size("words").cast("long"))


def word_frequencies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return (
        simple_tokens(df, text).select(key, F.explode("words").alias("word"))
        .groupBy(key, "word").agg(F.count("*").alias("freq"))
    )


def text_stats(df: DataFrame, key: str, text: str = "text", k: int = 10) -> DataFrame:
    """Top ``k`` words with unique and total counts per document, in one pass over the counts."""
    freq = word_frequencies(df, key, text)
    ranked = top_k(freq, [key], [F.desc("freq"), F.asc("word")], None)
    return ranked.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("rnk") <= k, F.struct("rnk", "word", "freq")))),
            lambda s: F.struct(s["word"].alias("word"), s["freq"].alias("freq")),
        ).alias("top_words"),
        F.count("*").alias("unique_count"),
        F.sum("freq").alias("total_count"),
    )


def text_report(stats: DataFrame, show: int = 5) -> DataFrame:
    top = F.array_join(
        F.transform(F.slice("top_words", 1, show),
                    lambda w: F.concat(w["word"], F.lit("("), w["freq"].cast("string"), F.lit(")"))), ", ")
    report = F.concat(
        F.lit("Text analysis: "), F.col("total_count").cast("string"), F.lit(" words, "),
        F.col("unique_count").cast("string"), F.lit(" unique. Top: "), top)
    return stats.withColumn("report", report)
