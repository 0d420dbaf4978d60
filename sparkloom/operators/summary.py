"""Key entities, keywords, topic refinement, quality and audience of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.draws import digests
from ..plans.grouped import map_lists, map_small_groups
from ..plans.ordered import top_k
from .analysis import KEY


def group_eigen_centrality(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """Eigenvector centrality of each document's small weighted graph ``(entity_a, entity_b, weight)``."""
    def one(a, b, weight) -> dict:
        ends = np.stack([np.asarray(a, dtype=str), np.asarray(b, dtype=str)], axis=1)
        nodes, idx = np.unique(ends, return_inverse=True)
        idx = idx.reshape(ends.shape)
        src = np.concatenate([idx[:, 0], idx[:, 1]])
        dst = np.concatenate([idx[:, 1], idx[:, 0]])
        w = np.asarray(weight, dtype=float)
        ww = np.concatenate([w, w])
        c = np.full(len(nodes), 1.0 / len(nodes))
        for _ in range(rounds):
            c = np.bincount(dst, weights=c[src] * ww, minlength=len(nodes))
            norm = np.sqrt((c * c).sum())
            c = c / norm if norm > 0 else c
        return {"entity": nodes, "centrality": c}

    return map_small_groups(edges, KEY, ["entity_a", "entity_b", "weight"], one, {"entity": "string", "centrality": "double"})


def interaction_edges(interactions: DataFrame) -> DataFrame:
    return interactions.select(KEY, "entity_a", "entity_b", (F.abs("combined") * F.col("cosine")).alias("weight"))


def key_entities(sentiment: DataFrame, centrality: DataFrame, k: int | None = 30) -> DataFrame:
    bonus = F.when(F.col("type") == "TECH", 3.0).when(F.col("type").isin("PERSON", "ORG"), 2.0).otherwise(1.0)
    out = sentiment.join(centrality, [KEY, "entity"], "left").withColumn(
        "centrality", F.coalesce("centrality", F.lit(0.0)))
    felt = F.when(F.col("net") != 0, F.abs("adjusted") * 0.5).otherwise(0.0)
    out = out.withColumn("importance", F.round(F.col("centrality") * 10 + bonus + felt, 6))
    return top_k(out, [KEY], [F.desc("importance"), F.asc("entity"), F.asc("type")], k)


def keywords(terms: DataFrame, k: int | None = 50) -> DataFrame:
    kept = terms.where(F.col("tag").isin(L.KEYWORD_TAGS) & (F.col("score") > 0)).drop("rnk")
    return top_k(kept, [KEY], [F.desc("score"), F.asc("word")], k)


def topic_em(ranks: DataFrame, rounds: int = 10, top: int | None = 50) -> DataFrame:
    """Soft topic affinity of a document by alternating word and topic steps.

    A word's step depends only on the topic that lists it (no word is in two lists), so the words of
    a document collapse to one mass per topic before the rounds, which are arithmetic in the row.
    """
    best = ranks if top is None else top_k(ranks, [KEY], [F.desc(F.round("rank", 9)), F.asc("word")], top)
    topics = list(L.TOPICS)
    n = len(topics)
    listed = [F.col("word").isin(keys) for keys in L.TOPICS.values()]
    anywhere = listed[0]
    for hit in listed[1:]:
        anywhere = anywhere | hit
    masses = F.array(*[F.sum(F.when(h, F.col("rank")).otherwise(0.0)) for h in listed],
                     F.sum(F.when(anywhere, 0.0).otherwise(F.col("rank"))))
    doc = best.groupBy(KEY).agg(masses.alias("mass"))

    def step(aff, _):
        # share[c][t]: probability of topic t for words of class c (class n = listed nowhere)
        def raw(c, t):
            return F.element_at(aff, t + 1) * (2.0 if c == t else 0.1)

        new = []
        for t in range(n):
            total = F.lit(0.0)
            for c in range(n + 1):
                norm = sum((raw(c, u) for u in range(1, n)), raw(c, 0))
                total = total + F.element_at("mass", c + 1) * raw(c, t) / norm
            new.append(total)
        added = F.array(*new)
        whole = F.aggregate(added, F.lit(0.0), lambda s, x: s + x)
        return F.transform(added, lambda x: x / whole)

    start = F.array(*[F.lit(1.0 / n)] * n)
    state = doc.withColumn("aff", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    return state.select(KEY, F.posexplode("aff").alias("i", "affinity")).select(
        KEY, F.element_at(F.array(*[F.lit(t) for t in topics]), F.col("i") + 1).alias("topic"), "affinity")


def topic_profile(scores: DataFrame, above: float = 0.05) -> DataFrame:
    """Significant topics and how much of the weight lies outside the first of them."""
    sig = scores.where(F.col("normalized") > above)
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("score"), F.asc("topic")))
    prof = sig.withColumn("rnk", rank).groupBy(KEY).agg(
        F.count("*").alias("n_significant"),
        F.sum(F.when(F.col("rnk") > 1, F.col("normalized")).otherwise(0.0)).alias("interdisciplinarity"))
    return scores.select(KEY).distinct().join(prof, KEY, "left").fillna(0)


def quality_profile(features: DataFrame) -> DataFrame:
    """Quality dimensions, their mean, and whether the genre's floors are met."""
    dims = {
        "vocabulary_sophistication": F.col("lexical_richness") * 0.4 + F.col("word_complexity") * 0.6,
        "lexical_diversity": F.col("ttr"),
        "formality_dim": F.col("formality"),
        "statistical_richness": F.least(F.col("honore_r") / 2000, F.lit(1.0)),
        "word_entropy_norm": F.least(F.col("word_entropy") / 12, F.lit(1.0)),
    }
    out = features.select("*", *[c.alias(n) for n, c in dims.items()])
    mean = sum((F.col(n) for n in list(dims)[1:]), F.col(list(dims)[0])) / len(dims)
    meets = F.lit(False)
    for g, (form, ttr, comp) in L.GENRE_FLOORS.items():
        meets = meets | ((F.col("genre") == g) & (F.col("formality") >= form) & (F.col("ttr") >= ttr)
                         & (F.col("word_complexity") >= comp))
    return out.withColumn("overall_quality", mean).withColumn("meets_floors", meets)


def mc_quality(features: DataFrame, intervals: DataFrame, draws: int = 500, seed: str = "quality") -> DataFrame:
    """Distribution of a quality score when its inputs vary within their bootstrap intervals."""
    base = features.select(KEY, "formality", "word_complexity").join(intervals, KEY)
    names = ["formality", "word_complexity", *[f"{c}_{x}" for c in ("ttr", "simpson") for x in ("mean", "lower", "upper")]]
    tails = digests(lambda i: [f":{i + 1}"])

    def one(name, values) -> dict:
        v = dict(zip(names, values))

        def drawn(tag, mean, spread):
            return np.maximum(0.0, mean + spread * tails(draws).normals(f"{seed}:{tag}:{name}", draws))

        def part(tag, c, floor):
            gap = v[f"{c}_upper"] - v[f"{c}_lower"]
            return drawn(tag, v[f"{c}_mean"], gap / 4 if gap > 0 else floor)

        q = np.sort(part("t", "ttr", 0.01) * 0.3 + (1 - part("s", "simpson", 0.001)) * 0.3 + drawn("f", v["formality"], 0.05) * 0.2
                    + v["word_complexity"] * 0.2)
        return {"mean": [q.mean()], "median": [q[draws // 2]], "p5": [q[int(draws * 0.05)]], "p95": [q[int(draws * 0.95)]], "std": [q.std()]}

    return map_lists(base, [KEY], [F.array(*names)], one, dict.fromkeys(("mean", "median", "p5", "p95", "std"), "double"), with_key=True)


def audience(level: DataFrame) -> DataFrame:
    who, simplify = F.lit("specialist"), F.lit(True)
    for name, (people, needs) in L.AUDIENCES.items():
        who = F.when(F.col("level") == name, people).otherwise(who)
        simplify = F.when(F.col("level") == name, needs).otherwise(simplify)
    v, a = F.col("variety"), F.col("avg_sentence_length")
    style = (F.when((v > 0.7) & (a > 15), "complex_varied").when(v > 0.5, "balanced")
             .when(a > 20, "dense").otherwise("simple"))
    return level.select("*", who.alias("audience"), simplify.alias("simplify"), style.alias("style"))
