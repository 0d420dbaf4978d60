"""Sentiment, term weights, topics, genre, reading level and sentence clusters of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.draws import digests
from ..functions.numeric import at_least, plogp
from ..plans.grouped import map_lists
from ..plans.iterate import cut
from ..plans.joins import attach
from ..plans.ordered import top_k
from .analysis import KEY, cosine_pairs


# ---------------------------------------------------------------- sentiment
def entity_sentiment(unique: DataFrame, contexts: DataFrame) -> DataFrame:
    """Sentiment of each entity from its context words; the word lists are fixed and small."""
    hits = [F.sum(F.when(F.col("word").isin(words), F.col("n")).otherwise(0)).alias(kind)
            for kind, words in L.SENTIMENT.items()]
    bag = contexts.groupBy(KEY, "entity").agg(*hits, F.sum("n").alias("context_size"))
    out = unique.join(bag, [KEY, "entity"], "left").fillna(
        0, ["positive", "negative", "intensifier", "negator", "context_size"])
    net = F.col("positive") - F.col("negative")
    sign = F.when(F.col("negator") > 0, -1.0).otherwise(1.0)
    return out.withColumn("net", net).withColumn(
        "adjusted", net * (1 + 0.5 * F.col("intensifier")) * sign).withColumn(
        "polarity", net / F.greatest("context_size", F.lit(1)))


def sentiment_interactions(pairs: DataFrame, sentiment: DataFrame, k: int | None = 50) -> DataFrame:
    """Combined sentiment and agreement of similar entity pairs."""
    s = sentiment.select(KEY, "entity", "adjusted").distinct()
    a = s.select(KEY, F.col("entity").alias("entity_a"), F.col("adjusted").alias("adj_a"))
    b = s.select(KEY, F.col("entity").alias("entity_b"), F.col("adjusted").alias("adj_b"))
    out = pairs.join(a, [KEY, "entity_a"]).join(b, [KEY, "entity_b"]).select(
        KEY, "entity_a", "entity_b", "cosine", (F.col("adj_a") + F.col("adj_b")).alias("combined"),
        F.when((F.col("adj_a") >= 0) == (F.col("adj_b") >= 0), 1).otherwise(-1).alias("agreement"))
    return top_k(out, [KEY], [F.desc("cosine"), F.asc("entity_a"), F.asc("entity_b")], k)


def sentiment_by_type(sentiment: DataFrame) -> DataFrame:
    return sentiment.groupBy(KEY, "type").agg(
        F.count_if(F.col("net") > 0).alias("pos"), F.count_if(F.col("net") < 0).alias("neg"),
        F.count_if(F.col("net") == 0).alias("neutral"), F.sum("adjusted").alias("total_adjusted"))


def sentiment_profile(sentiment: DataFrame) -> DataFrame:
    """Subjectivity, type ratios and polarity balance per document."""
    n = F.count("*")
    pos, neg = F.count_if(F.col("net") > 0), F.count_if(F.col("net") < 0)
    def mentions(kind):
        return F.sum(F.when(F.col("type") == kind, F.col("mentions")).otherwise(0))

    return sentiment.groupBy(KEY).agg(
        n.alias("n_entities"), (F.count_if(F.col("net") != 0) / n).alias("subjectivity"),
        (mentions("TECH") / n).alias("tech_ratio"), (mentions("PERSON") / n).alias("person_ratio"),
        pos.alias("positive"), neg.alias("negative"),
        F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral").alias("overall"))


# ---------------------------------------------------------------- terms
def pos_tfidf(top: DataFrame, totals: DataFrame) -> DataFrame:
    """Tag-weighted term score ``tf * weight`` with the best tag per word.

    ``top`` holds the frequent words per tag, ``totals`` the token count per document.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in L.TAG_WEIGHTS.items() for x in kv]),
                                     F.col("tag")), F.lit(1.0))
    scored = top.join(totals, KEY).withColumn("tf", F.col("freq") / F.col("total")).withColumn(
        "score", F.round(F.col("tf") * weight, 9))
    best = scored.groupBy(KEY, "word").agg(
        F.min_by(F.struct("tag", "freq", "tf", "score"), F.struct(-F.col("score"), "tag")).alias("b"))
    return best.select(KEY, "word", "b.tag", "b.freq", "b.tf", "b.score")


def top_terms(terms: DataFrame, k: int | None = 100) -> DataFrame:
    return top_k(terms, [KEY], [F.desc("score"), F.asc("word")], k)


def term_norm(terms: DataFrame) -> DataFrame:
    return terms.groupBy(KEY).agg(F.count("*").alias("dim"),
                                  F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))


def by_frequency(counts: DataFrame, frequent_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document frequencies, the frequent ones, rows of the other words).

    There are at most rows / frequent_rows frequent words, so their table may be broadcast; what is left meets at
    most ``frequent_rows`` rows of a word in one task.
    """
    df = cut(counts.groupBy("word").agg(F.count("*").alias("df")))
    frequent = df.where(F.col("df") > frequent_rows)
    return df, frequent, counts.join(F.broadcast(frequent.select("word")), "word", "left_anti")


def tfidf(counts: DataFrame, frequent_rows: int = 100_000) -> DataFrame:
    """TF-IDF over the whole corpus, from one pass over the counts.

    Words that very many documents hold get their weight where their rows lie; only the others are shuffled.
    """
    counts = cut(counts.withColumn("tf", F.col("freq") / F.sum("freq").over(Window.partitionBy(KEY))).select(KEY, "word", "tf"))
    n_docs = counts.select(KEY).distinct().agg(F.count("*").alias("n_docs"))
    df, frequent, rest = by_frequency(counts, frequent_rows)
    idf = lambda d: attach(d, n_docs).select("word", F.ln(F.col("n_docs") / F.col("df")).alias("idf"))
    both = counts.join(F.broadcast(idf(frequent)), "word").unionByName(rest.join(idf(df), "word"))
    return both.select(KEY, "word", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def term_cooccurrence(tokens: DataFrame, terms: DataFrame, window: int = 5) -> DataFrame:
    """Symmetric context counts of the chosen terms within ``window`` tokens."""
    kept = tokens.select(KEY, "pos", F.lower("token").alias("word")).join(terms.select(KEY, "word"), [KEY, "word"])
    order = Window.partitionBy(KEY).orderBy("pos")
    near = F.array(*[F.lead(F.struct("pos", "word"), s).over(order) for s in range(1, window + 1)])
    pairs = kept.withColumn("near", near).select(
        KEY, "word", F.explode(F.filter("near", lambda s: s["pos"] <= F.col("pos") + window)).alias("m"))
    counted = pairs.groupBy(KEY, F.least("word", "m.word").alias("x"), F.greatest("word", "m.word").alias("y")).agg(
        (F.count("*") * 2).alias("n"))
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("term"), F.col("y").alias("ctx")))
                  ).otherwise(F.array(F.struct(F.col("x").alias("term"), F.col("y").alias("ctx")),
                                      F.struct(F.col("y").alias("term"), F.col("x").alias("ctx"))))
    return counted.select(KEY, "n", F.explode(both).alias("e")).select(KEY, "e.term", "e.ctx", "n")


def term_similarity(cooc: DataFrame, k: int | None = 100, above: float = 0.1) -> DataFrame:
    return cosine_pairs(cooc, "term", "ctx", "n", above, k, ("term_a", "term_b"))


def transition_entropy(transitions: DataFrame) -> DataFrame:
    p = F.col("n") / F.sum("n").over(Window.partitionBy(KEY))
    return transitions.withColumn("p", p).groupBy(KEY).agg((-F.sum(plogp(F.col("p")))).alias("entropy"))


# ---------------------------------------------------------------- topics
def primary_topic(scores: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("topic", "score", "normalized"), F.struct(-F.col("score"), "topic")).alias("b")
    return scores.groupBy(KEY).agg(best).select(KEY, "b.topic", "b.score", "b.normalized")


def topic_pagerank(ranks: DataFrame) -> DataFrame:
    sums = [F.sum(F.when(F.col("word").isin(keys), F.col("rank")).otherwise(0.0)).alias(t)
            for t, keys in L.TOPICS.items()]
    return ranks.groupBy(KEY).agg(*sums)


# ---------------------------------------------------------------- features
def genre(richness: DataFrame) -> DataFrame:
    """Formality, normalised features and the genre rule."""
    w, t = F.col("avg_word_length"), F.col("ttr")
    formality = (w / 8) * 0.4 + (1 - F.col("simpson")) * 0.3 + t * 0.3
    return richness.select(
        "*", (1 - F.col("simpson")).alias("lexical_richness"), F.least(w / 10, F.lit(1.0)).alias("word_complexity"),
        F.least(F.col("brunet_w") / 100, F.lit(1.0)).alias("vocabulary_growth"),
        F.least(F.greatest(formality, F.lit(0.0)), F.lit(1.0)).alias("formality"),
        F.when((t > 0.6) & (w > 5), "academic").when((t > 0.5) & (w > 4.5), "technical")
        .when(t > 0.4, "journalistic").otherwise("conversational").alias("genre"))


def spectrum_bootstrap(zipf: DataFrame, replicates: int = 200, seed: str = "42") -> DataFrame:
    """Bootstrap interval of type-token ratio, hapax ratio and Simpson index over the Zipf table.

    The resampled list is the Zipf table of one document (``top_n`` rows), held in the row; all its replicates are
    drawn there at once.
    """
    freqs = F.transform(F.array_sort(F.collect_list(F.struct("zipf_rank", "freq"))), lambda s: s["freq"])
    tails = digests(lambda i: [f":{rep}:{i}" for rep in range(1, replicates + 1)])
    kinds = ("ttr", "hapax_ratio", "simpson")

    def one(name, f) -> dict:
        n = len(f)
        u = tails(n).uniforms(f"{seed}:{name}", n * replicates)[0]
        s = np.sort(f[(u * n % n).astype(np.int64)].reshape(n, replicates), axis=0)
        total, pairs = s.sum(axis=0), (s * (s - 1)).sum(axis=0)
        distinct = 1 + (s[1:] != s[:-1]).sum(axis=0)
        out = {}
        for c, v in zip(kinds, (distinct / np.maximum(total, 1), (s == 1).sum(axis=0) / distinct, pairs / np.maximum(total * (total - 1), 1))):
            v = np.sort(v)
            out |= {f"{c}_mean": [v.mean()], f"{c}_lower": [v[int(replicates * 0.025)]], f"{c}_upper": [v[int(replicates * 0.975)]]}
        return out

    return map_lists(zipf.groupBy(KEY).agg(freqs.alias("f")), [KEY], [F.col("f")], one,
                     {f"{c}_{x}": "double" for c in kinds for x in ("mean", "lower", "upper")}, with_key=True)


def reading_level(read: DataFrame) -> DataFrame:
    g, s = F.col("fk_grade"), F.col("std_sentence_length")
    return read.select(
        "*",
        F.when(g <= 6, "elementary").when(g <= 9, "middle_school").when(g <= 12, "high_school")
        .when(g <= 16, "undergraduate").otherwise("graduate").alias("level"),
        F.least(F.lit(1.0), (g / 20) * 0.4 + (F.col("avg_syllables") / 3) * 0.3 + (s / 15) * 0.3).alias("complexity"),
        F.when(s > 0, 1.0 - F.exp(-s / 5)).otherwise(0.0).alias("variety"))


def sentence_clusters(sents: DataFrame, k: int = 5, rounds: int = 20, vocabulary: int = 100,
                      seed: int = 42) -> DataFrame:
    """k-means of unit-length sentence vectors over the most frequent words."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import CountVectorizer, Normalizer
    from pyspark.ml.functions import vector_to_array

    from ..functions.text import word_array

    prepared = sents.withColumn("words", word_array(F.lower("sentence")))
    steps = Pipeline(stages=[
        CountVectorizer(inputCol="words", outputCol="tf", vocabSize=vocabulary),
        Normalizer(inputCol="tf", outputCol="features", p=2.0),
        KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="features", predictionCol="cluster"),
    ])
    model = steps.fit(prepared)
    centres = [[float(x) for x in c] for c in model.stages[-1].clusterCenters()]
    table = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])
    scored = model.transform(prepared).withColumn("v", vector_to_array("features"))
    dist = F.aggregate(F.zip_with("v", F.element_at(table, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b)),
                       F.lit(0.0), lambda s, x: s + x)
    return scored.groupBy("cluster").agg(F.count("*").alias("size"), F.sqrt(F.avg(dist)).alias("intra_distance"))
