"""Entities, collocations, richness, readability and cohesion of documents.

Groups are documents: each is one row of the input, so windows and arrays keyed by the
document id are bounded by one document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.numeric import at_least, plogp
from ..plans.grouped import map_small_groups
from ..plans.ordered import top_k

KEY = "doc_id"
_ENTITY = "array<struct<method:int,ord:int,text:string,type:string>>"


# ---------------------------------------------------------------- entities
def entities_dict(sentence: Column) -> Column:
    """Known names contained in the sentence (substring match), as an array."""
    known = F.array(*[
        F.struct(F.lit(0).alias("method"), F.lit(i).alias("ord"), F.lit(term.title()).alias("text"),
                 F.lit(kind).alias("type"), F.lit(term).alias("term"))
        for i, (term, kind) in enumerate(L.KNOWN_ENTITIES)
    ])
    hits = F.filter(known, lambda e: F.contains(F.lower(sentence), e["term"]))
    return F.transform(hits, lambda e: F.struct(e["method"], e["ord"], e["text"], e["type"])).cast(_ENTITY)


def _found(sentence: Column, pattern: str, method: int, kind) -> Column:
    hits = T.find_all(sentence, pattern)
    return F.transform(hits, lambda h, i: F.struct(
        F.lit(method).alias("method"), i.alias("ord"), h.alias("text"), kind(h).alias("type"))).cast(_ENTITY)


def entities_pattern(sentence: Column) -> Column:
    """Capitalised phrases of two or more words: titled person, organisation, or plain entity."""
    def kind(phrase):
        words = F.split(F.lower(phrase), r"\s+")
        return (
            F.when(F.element_at(words, 1).isin(L.PERSON_TITLES), "PERSON")
            .when(F.arrays_overlap(words, F.array(*[F.lit(s) for s in L.ORG_SUFFIXES])), "ORG")
            .otherwise("ENTITY")
        )
    found = _found(sentence, T.PHRASE, 1, kind)
    return F.filter(found, lambda e: ~F.lower(e["text"]).isin([t for t, _ in L.KNOWN_ENTITIES]))


def entities_misc(sentence: Column) -> Column:
    """Years and acronyms."""
    years = _found(sentence, T.YEAR, 2, lambda _: F.lit("DATE"))
    caps = _found(sentence, T.ACRONYM, 3, lambda _: F.lit("ACRONYM"))
    return F.concat(years, F.filter(caps, lambda e: ~F.lower(e["text"]).isin(L.NOT_ACRONYMS)))


def entities(sents: DataFrame, parts=(entities_dict, entities_pattern, entities_misc)) -> DataFrame:
    """``(key, sent_idx, method, ord, text, type)`` of every entity mention."""
    found = F.concat(*[p(F.col("sentence")) for p in parts])
    return sents.select(KEY, "sent_idx", F.inline(found))


def unique_entities(ents: DataFrame) -> DataFrame:
    """Distinct ``(lower text, type)`` per document, spelled as first seen."""
    return ents.groupBy(KEY, F.lower("text").alias("entity"), "type").agg(
        F.min_by("text", F.struct("sent_idx", "method", "ord")).alias("text"), F.count("*").alias("mentions"))


def entity_summary(ents: DataFrame) -> DataFrame:
    return unique_entities(ents).groupBy(KEY, "type").agg(
        F.count("*").alias("n_unique"), F.sum("mentions").alias("n_found"))


def entity_bags(df: DataFrame, text: str = "text") -> DataFrame:
    """Full context bags ``(key, entity, word, n)``: words of all sentences that contain the entity.

    The containment test between a document's entities and its sentences runs inside the row, so
    there is no join at all and documents without entities produce nothing.
    """
    base = df.select(KEY, T.sentence_array(F.col(text)).alias("s"))
    found = F.flatten(F.transform("s", lambda x: F.concat(entities_dict(x), entities_pattern(x), entities_misc(x))))
    names = F.array_distinct(F.transform(found, lambda e: F.lower(e["text"])))
    each = base.select(KEY, "s", F.explode(names).alias("entity"))
    inside = F.filter("s", lambda x: F.contains(F.lower(x), F.col("entity")))
    words = each.select(KEY, "entity", F.explode(F.flatten(F.transform(inside, lambda x: T.word_array(F.lower(x))))).alias("word"))
    return words.where((F.col("word") != F.col("entity")) & (F.length("word") > 2)).groupBy(KEY, "entity", "word").agg(
        F.count("*").alias("n"))


def entity_contexts(bags: DataFrame, k: int | None = 30) -> DataFrame:
    return top_k(bags, [KEY, "entity"], [F.desc("n"), F.asc("word")], k)


def near_items(labels, feats, values, above: float, k: int | None) -> tuple[np.ndarray, ...]:
    """(items, x, y, cosine): places of the items of one document whose cosine is above a limit, the best ``k`` of them."""
    items, i = np.unique(np.asarray(labels, dtype=str), return_inverse=True)
    feats, j = np.unique(np.asarray(feats, dtype=str), return_inverse=True)
    m = np.zeros((len(items), len(feats)))
    m[i, j] = np.asarray(values, dtype=float)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    x, y, c = np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
    for lo in range(0, len(items), 512):
        sim = np.round(m[lo:lo + 512] @ m.T, 6)
        px, py = np.nonzero(sim > above)
        keep = py > px + lo
        x = np.concatenate([x, px[keep] + lo])
        y = np.concatenate([y, py[keep]])
        c = np.concatenate([c, sim[px[keep], py[keep]]])
        best = np.lexsort((y, x, -c))[:k]
        x, y, c = x[best], y[best], c[best]
    return items, x, y, c


def cosine_pairs(vectors: DataFrame, item: str, feature: str, value: str, above: float, k: int | None,
                 names: tuple[str, str]) -> DataFrame:
    """Pairs of items of one document with cosine above a limit, best ``k`` per document.

    One document's items form a small matrix, so its pairwise cosines are one matrix product;
    rows are processed in blocks to bound memory.
    """
    a_name, b_name = names

    def one(labels, feats, values) -> dict:
        items, x, y, c = near_items(labels, feats, values, above, k)
        return {a_name: items[x], b_name: items[y], "cosine": c}

    return map_small_groups(vectors, KEY, [item, feature, value], one,
                            {a_name: "string", b_name: "string", "cosine": "double"})


def entity_similarity(bags: DataFrame, k: int | None = 100, above: float = 0.01) -> DataFrame:
    return cosine_pairs(bags, "entity", "word", "n", above, k, ("entity_a", "entity_b"))


# ---------------------------------------------------------------- tags
def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy(KEY, "tag", F.lower("token").alias("word")).agg(F.count("*").alias("freq"))


def top_per_pos(tags: DataFrame, k: int | None = 20) -> DataFrame:
    return top_k(tag_counts(tags), [KEY, "tag"], [F.desc("freq"), F.asc("word")], k)


def lexical_density(tags: DataFrame) -> DataFrame:
    return tags.groupBy(KEY).agg(
        F.count_if(F.col("tag").isin(L.CONTENT_TAGS)).alias("content"), F.count("*").alias("total")
    ).withColumn("density", F.col("content") / F.col("total"))


def pos_ngrams(df: DataFrame, n: int, k: int | None, text: str = "text") -> DataFrame:
    """Counts of tag n-grams; the tag sequence and its n-grams are formed inside the row."""
    tags = F.transform(T.word_array(F.col(text)), T.tag)
    grams = df.select(KEY, tags.alias("t")).select(KEY, F.explode(T.ngram_array(F.col("t"), n)).alias("seq"))
    counts = grams.groupBy(KEY, "seq").agg(F.count("*").alias("n"))
    return top_k(counts, [KEY], [F.desc("n"), F.asc("seq")], k)


def pos_mi(df: DataFrame, k: int | None = 60) -> DataFrame:
    """Mutual information of neighbouring tags, strongest ``k`` by absolute value."""
    big = pos_ngrams(df, 2, None).drop("rnk")
    uni = pos_ngrams(df, 1, None).drop("rnk")
    per_doc = Window.partitionBy(KEY)
    uni = uni.withColumn("p", F.col("n") / F.sum("n").over(per_doc)).select(KEY, F.col("seq").alias("t"), "p")
    parts = F.split("seq", " ")
    big = big.select(KEY, parts[0].alias("t1"), parts[1].alias("t2"), "n",
                     (F.col("n") / F.sum("n").over(per_doc)).alias("joint"))
    u1 = uni.select(KEY, F.col("t").alias("t1"), F.col("p").alias("p1"))
    u2 = uni.select(KEY, F.col("t").alias("t2"), F.col("p").alias("p2"))
    mi = big.join(u1, [KEY, "t1"]).join(u2, [KEY, "t2"]).withColumn(
        "mi", F.log2(F.col("joint") / (F.col("p1") * F.col("p2"))))
    return top_k(mi, [KEY], [F.desc(F.abs(F.round("mi", 6))), F.asc("t1"), F.asc("t2")], k)


# ---------------------------------------------------------------- richness
def lexical_richness(counts: DataFrame, top_n: int | None = None) -> DataFrame:
    """Vocabulary richness of every document over the whole vocabulary or its ``top_n`` words."""
    shown = top_k(counts, [KEY], [F.desc("freq"), F.asc("word")], None)
    in_top = F.lit(True) if top_n is None else F.col("rnk") <= top_n
    n = F.sum("freq").over(Window.partitionBy(KEY))
    shown = shown.withColumn("n", n).withColumn("f", F.when(in_top, F.col("freq")))
    p = F.col("f") / F.col("n")
    agg = shown.groupBy(KEY).agg(
        F.max("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("freq") == 1).alias("h"),
        F.sum(F.col("f") * (F.col("f") - 1)).alias("s"), F.sum(F.col("f") * F.col("f")).alias("m2"),
        F.count_if(F.col("f") == 2).alias("dis"), (-F.sum(plogp(p))).alias("word_entropy"),
        F.sum(F.length("word") * F.col("freq")).alias("chars"),
    )
    n, v = F.col("n").cast("double"), F.col("v").cast("double")
    return agg.select(
        KEY, "n", "v", "h",
        (F.col("s") / at_least(n * (n - 1), 1)).alias("simpson"),
        F.pow(n, F.pow(v, F.lit(-0.172))).alias("brunet_w"),
        (F.lit(100.0) * F.ln(n) / at_least(1 - F.col("h") / v, 0.001)).alias("honore_r"),
        (F.lit(10000.0) * (F.col("m2") - n) / at_least(n * n, 1)).alias("yule_k"),
        (F.col("dis") / v).alias("sichel_s"), "word_entropy",
        (F.col("h") / v).alias("hapax_ratio"), (F.col("chars") / n).alias("avg_word_length"),
        (v / n).alias("ttr"),
    )


def frequency_spectrum(counts: DataFrame, top_n: int | None = None) -> DataFrame:
    kept = top_k(counts, [KEY], [F.desc("freq"), F.asc("word")], top_n)
    return kept.groupBy(KEY, "freq").agg(F.count("*").alias("n_words"))


def zipf_mandelbrot(zipf: DataFrame) -> DataFrame:
    """Least-squares fit of ``c / (rank + b)^a`` over a fixed grid.

    The grid has 600 points, so it is evaluated with numpy per Arrow batch instead of exploding
    every word row 600 times.
    """
    freqs = F.transform(F.array_sort(F.collect_list(F.struct("zipf_rank", "freq"))), lambda s: s["freq"].cast("double"))
    arr = zipf.groupBy(KEY).agg(freqs.alias("f"))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(5, 25) / 10.0, np.arange(30) / 10.0, indexing="ij"))

    @F.pandas_udf("a double, b double, sse double")
    def fit(column: pd.Series) -> pd.DataFrame:
        out = []
        for f in column:
            f = np.asarray(f, dtype=float)
            shape = (np.arange(1, len(f) + 1)[None, :] + b[:, None]) ** -a[:, None]
            sse = np.round(((f[None, :] - f[0] * shape) ** 2).sum(axis=1), 6)
            best = int(np.argmin(sse))
            out.append((a[best], b[best], sse[best]))
        return pd.DataFrame(out, columns=["a", "b", "sse"])

    return arr.withColumn("best", fit("f")).select(KEY, "best.a", "best.b", "best.sse")


# ---------------------------------------------------------------- readability, networks
def readability(df: DataFrame, text: str = "text") -> DataFrame:
    """Readability indices of whole documents, computed inside the row: no shuffle at all."""
    base = df.select(KEY, F.transform(T.sentence_array(F.col(text)), T.word_array).alias("s"))
    base = base.withColumn("len", F.transform("s", lambda w: F.size(w).cast("double"))).withColumn("w", F.flatten("s"))

    def total(col, f=lambda x: x):
        return F.aggregate(col, F.lit(0.0), lambda a, x: a + f(x))

    base = base.select(
        KEY, F.size("s").cast("double").alias("n_sent"), F.size("w").cast("double").alias("n_words"),
        total("w", lambda x: T.syllables(x)).alias("syll"), total("w", lambda x: F.length(x)).alias("chars"), "len")
    avg = F.col("n_words") / at_least(F.col("n_sent"), 1)
    base = base.withColumn("avg_sentence_length", avg)
    ss = total("len", lambda x: (x - F.col("avg_sentence_length")) * (x - F.col("avg_sentence_length")))
    words = at_least(F.col("n_words"), 1)
    base = base.withColumn("std_sentence_length", F.when(F.col("n_sent") > 1, F.sqrt(ss / (F.col("n_sent") - 1)))
                           .otherwise(0.0)).withColumn("avg_syllables", F.col("syll") / words)
    return base.select(
        KEY, F.col("n_sent").cast("long").alias("n_sentences"), "avg_sentence_length", "std_sentence_length",
        "avg_syllables",
        (206.835 - 1.015 * avg - 84.6 * F.col("avg_syllables")).alias("flesch"),
        (0.39 * avg + 11.8 * F.col("avg_syllables") - 15.59).alias("fk_grade"),
        (0.0588 * (F.col("chars") / words * 100) - 0.296 * (F.col("n_sent") / words * 100) - 15.8).alias("coleman_liau"),
    )


def network_density(cooc: DataFrame, counts: DataFrame) -> DataFrame:
    edges = cooc.groupBy(KEY).agg(F.count("*").alias("n_edges"))
    n = counts.groupBy(KEY).agg(F.count("*").alias("n_nodes"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return n.join(edges, KEY, "left").select(
        KEY, "n_nodes", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"),
        (F.coalesce("n_edges", F.lit(0)) / at_least(possible, 1)).alias("density"))
