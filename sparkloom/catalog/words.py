"""WC: word count."""

from pyspark.sql import functions as F

from ..operators import wordcount as W
from .base import query, texts

SPLIT = """w AS (SELECT doc_id, unnest(l) AS word, (generate_subscripts(l, 1) - 1)::INT AS pos FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS l FROM documents))"""


def sql_reducer(word, n):
    acc = "0::BIGINT"
    for i in range(8):
        acc = f"(({acc} * 4294967296 + ('0x' || substr(sha256({word}), {8 * i + 1}, 8))::BIGINT) % {n})"
    return acc


@query("WC-01", f"WITH {SPLIT} SELECT doc_id, pos, word FROM w")
def _(spark, d):
    return W.words(texts(spark, d))


@query("WC-02", f"WITH {SPLIT} SELECT word, {sql_reducer('word', 3)} AS reducer FROM (SELECT DISTINCT word FROM w)")
def _(spark, d):
    return W.assign_reducer(W.word_count(texts(spark, d)), "word", 3).select("word", "reducer")


@query("WC-03", f"""WITH {SPLIT} SELECT doc_id, word, count(*) AS ones FROM w GROUP BY ALL""")
def _(spark, d):
    return W.words(texts(spark, d)).groupBy("doc_id", "word").agg(F.count("*").alias("ones"))


@query("WC-04", f"WITH {SPLIT} SELECT word, count(*) AS n FROM w GROUP BY word")
def _(spark, d):
    return W.word_count(texts(spark, d))


@query("WC-05", f"""WITH {SPLIT}, c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT {sql_reducer('word', 3)} AS reducer, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS bucket,
  count(*) AS n_words, sum(n)::BIGINT AS n_total, string_agg(word || '=' || n, ' ' ORDER BY word) AS counts
FROM c GROUP BY 1, 2""")
def _(spark, d):
    m = W.word_count_map(W.word_count(texts(spark, d)), 3, 64)
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("reducer", "bucket", F.size("counts").cast("long").alias("n_words"), total.alias("n_total"),
                    F.array_join(pairs, " ").alias("counts"))
