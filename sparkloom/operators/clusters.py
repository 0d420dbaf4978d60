"""Many small k-means at once: one clustering for each document or sequence.

A group is bounded by the text or sequence it comes from, so it travels as one row; a batch of rows carries many
groups.  Lloyd's rounds stop for a group as soon as its assignment has settled.  Starts are the items with the smallest
digests, so a retried task and an equivalent query find the same clusters.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_array
from ..plans.grouped import map_lists, map_small_groups
from .analysis import near_items

#: Digits to which squared distances are compared, so that equal ones are ties: the first centre wins.
DIGITS = 12


def lloyd(x: np.ndarray, starts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(assignment, centres) after at most ``rounds``; a centre without members stays where it is."""
    centres, last = x[starts].astype(float), None
    size = (x * x).sum(axis=1)
    for _ in range(rounds):
        far = np.round(size[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], DIGITS)
        now = np.argmin(far, axis=1)
        if last is not None and (now == last).all():
            break
        last = now
        for c in range(len(centres)):
            members = x[now == c]
            if len(members):
                centres[c] = members.mean(axis=0)
    return last, centres


def start_order(group: str, item: str, seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(item).cast("string")))


def _matrix(items: list, features: list, values: list) -> tuple[np.ndarray, np.ndarray]:
    """(distinct items, dense matrix) of sparse rows; a row without a feature is an item with nothing."""
    names, row = np.unique(np.array(items), return_inverse=True)
    known = {f: i for i, f in enumerate(sorted({f for f in features if f is not None}))}
    x = np.zeros((len(names), len(known)))
    for r, f, v in zip(row.tolist(), features, values):
        if f is not None:
            x[r, known[f]] = v
    return names, x


def _starts(names: np.ndarray, items: list, digests: list, k: int) -> np.ndarray:
    first = dict(zip(items, digests))
    return np.argsort(np.array([first[i] for i in names.tolist()]), kind="stable")[:k]


def group_clusters(points: DataFrame, group: str, item: str, feature: str, value: str, most: int, per: int | None = None,
                   rounds: int = 20, seed: int = 42) -> DataFrame:
    """(group, item, cluster, distance2): Lloyd's clusters of the items of every group over sparse rows (feature, value).

    ``most`` clusters, or with ``per`` one for each so many items, from 2 up to ``most``.  Groups with fewer items
    than clusters have no rows.  Items are whole numbers or texts; an item without features gives one row of nulls.
    """
    def cluster(items, features, values, digests):
        names, x = _matrix(items, features, values)
        k = most if per is None else min(most, max(2, len(names) // per))
        if len(names) < k or not x.shape[1]:
            return {item: [], "cluster": [], "distance2": []}
        found, centres = lloyd(x, _starts(names, items, digests, k), rounds)
        return {item: names.tolist(), "cluster": found.tolist(), "distance2": ((x - centres[found]) ** 2).sum(axis=1).tolist()}

    rows = points.select(group, item, feature, value, start_order(group, item, seed).alias("digest"))
    kind = points.schema[item].dataType.simpleString()
    return map_small_groups(rows, group, [item, feature, value, "digest"], cluster, {item: kind, "cluster": "int", "distance2": "double"})


def sentence_vectors(sents: DataFrame, key: str = "doc_id", top: int = 100) -> DataFrame:
    """(key, sent_idx, word, x): unit vectors of the sentences over the ``top`` most frequent words of their document.

    Frequencies are those of the sentences' words; ties go to the smaller word.  A sentence without such a word has one
    row of nulls.
    """
    words = sents.select(key, "sent_idx", F.explode_outer(word_array(F.lower("sentence"))).alias("word"))
    counts = words.groupBy(key, "sent_idx", "word").agg(F.count("word").alias("n"))
    counts = counts.withColumn("freq", F.sum("n").over(Window.partitionBy(key, "word")))
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("freq"), F.asc_nulls_last("word")))
    kept = counts.withColumn("n", F.when((F.col("n") > 0) & (rank <= top), F.col("n")))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key, "sent_idx")))
    return kept.select(key, "sent_idx", F.when(F.col("n").isNotNull(), F.col("word")).alias("word"), (F.col("n") / norm).alias("x")).distinct()


def sentence_clusters(sents: DataFrame, key: str = "doc_id", most: int = 5, per: int = 10, top: int = 100, rounds: int = 20) -> DataFrame:
    """(key, cluster, size, intra_distance) of the sentences of every document."""
    found = group_clusters(sentence_vectors(sents, key, top), key, "sent_idx", "word", "x", most, per, rounds)
    return found.groupBy(key, "cluster").agg(F.count("*").alias("size"), F.sqrt(F.avg("distance2")).alias("intra_distance"))


def kmer_clusters(profiles: DataFrame, key: str = "seq_id", k: int = 4, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(key, cluster, size, avg_gc) of the k-mers of every sequence by GC share and scaled observed/expected ratio."""
    def one(name, kmer, gc, obs_exp) -> dict:
        if len(kmer) < k:
            return {"cluster": [], "size": [], "avg_gc": []}
        x = np.stack([gc, obs_exp / max(obs_exp.max(), 1.0)], axis=1)
        digests = [hashlib.md5(f"{seed}:{name}:{m}".encode()).hexdigest() for m in kmer]
        found, _ = lloyd(x, np.argsort(np.array(digests), kind="stable")[:k], rounds)
        kinds, at, size = np.unique(found, return_inverse=True, return_counts=True)
        return {"cluster": kinds, "size": size, "avg_gc": np.bincount(at, weights=gc) / size}

    return map_lists(profiles, [key], [F.col(f"profile.{c}") for c in ("kmer", "gc", "obs_exp")], one,
                     {"cluster": "int", "size": "long", "avg_gc": "double"}, with_key=True)


def tightness(x: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Mean distance of the items from the centres of their clusters, weighted by size, for every row of ``labels``."""
    squares, total = (x * x).sum(axis=1), np.zeros(len(labels))
    for c in range(k):
        mine = labels == c
        n = mine.sum(axis=1)
        some = np.maximum(n, 1)
        centres = mine @ x / some[:, None]
        total += n * np.sqrt(np.maximum(mine @ squares / some - (centres * centres).sum(axis=1), 0))
    return total / labels.shape[1]


def cluster_significance(sents: DataFrame, key: str = "doc_id", permutations: int = 200, most: int = 5, per: int = 10,
                         top: int = 100, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(key, observed_intra, perm_mean, p_value, permutations): are a document's sentence clusters tighter than chance?

    The labels of its own sentences are shuffled, so sizes stay; the p-value is the share of shuffles at most as
    wide.  Documents with fewer than two clusters have no row.
    """
    def test(items, words, values, digests):
        names, x = _matrix(items, words, values)
        k = min(most, max(2, len(names) // per))
        none = {"observed_intra": [], "perm_mean": [], "p_value": []}
        if len(names) < k or not x.shape[1]:
            return none
        found, _ = lloyd(x, _starts(names, items, digests, k), rounds)
        if len(np.unique(found)) < 2:
            return none
        rng = np.random.default_rng([seed, *[int(d[:8], 16) for d in sorted(set(digests))[:2]]])
        step = max(1, 4_000_000 // len(found))
        observed, shuffled = tightness(x, found[None, :], k)[0], []
        for lo in range(0, permutations, step):
            shuffled.append(tightness(x, rng.permuted(np.tile(found, (min(step, permutations - lo), 1)), axis=1), k))
        shuffled = np.concatenate(shuffled)
        return {"observed_intra": [float(observed)], "perm_mean": [float(shuffled.mean())], "p_value": [float(np.mean(shuffled <= observed + 1e-12))]}

    rows = sentence_vectors(sents, key, top).withColumn("digest", start_order(key, "sent_idx", seed))
    out = map_small_groups(rows, key, ["sent_idx", "word", "x", "digest"], test, {"observed_intra": "double", "perm_mean": "double", "p_value": "double"})
    return out.withColumn("significant", F.col("p_value") < 0.05).withColumn("permutations", F.lit(permutations))


def linked_labels(links: DataFrame, group: str, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """(group, item, label): the smallest item of every item's component, or with ``rounds`` that within so many links of it.

    The links of a group are bounded (pairs of the terms of one document), so its rounds run in its row.
    """
    return map_small_groups(links, group, [a, b], lambda left, right: _labels(left, right, rounds), {"item": "string", "label": "string"})


def _labels(left, right, rounds: int | None = None) -> dict:
    names, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = np.split(ends, 2)
    label, done = np.arange(len(names)), 0
    while rounds is None or done < rounds:
        last, label, done = label, label.copy(), done + 1
        np.minimum.at(label, i, last[j])
        np.minimum.at(label, j, last[i])
        if (label == last).all():
            break
    return {"item": names, "label": names[label]}


def similar_labels(vectors: DataFrame, item: str, feature: str, value: str, distance: float, key: str = "doc_id") -> DataFrame:
    """(key, item, label): single-linkage clusters of the items of one document, by all pairs with 1 - cosine up to a distance.

    Pairs and labels are formed where the vectors of the document lie; no pair leaves its row.
    """
    def one(labels, feats, values) -> dict:
        items, x, y, c = near_items(labels, feats, values, 0.999 - distance, None)
        close = 1 - c <= distance
        return _labels(items[x[close]], items[y[close]])

    return map_small_groups(vectors, key, [item, feature, value], one, {"item": "string", "label": "string"})
