"""Phrases of single documents: n-grams, collocations, their patterns, graphs and topics, word pairs, cohesion.

A document's phrases come from its own words, so they are counted, ranked and scored inside its row; only the rows
asked for leave it, and nothing but the texts is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..plans.grouped import map_lists

KEY = "doc_id"


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """All texts of a key, nearly always one, in one row."""
    return df.groupBy(key).agg(F.collect_list(text).alias("texts"))


def _words(texts: Column | str, first=lambda t: t) -> Column:
    """The words of every text, joined by blanks."""
    return F.transform(texts, lambda t: F.array_join(T.word_array(first(t)), " "))


def _per_document(df: DataFrame, fn, schema: dict[str, str], key: str = KEY, text: str = "text") -> DataFrame:
    """``fn`` of the lower-cased words of a document's texts."""
    return map_lists(_texts(df, key, text), [key], [_words("texts", F.lower)], fn, schema)


def _columns(rows: list[tuple], names) -> dict:
    return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}


# ---------------------------------------------------------------- one document
def _numbered(texts) -> tuple[list[str], list[np.ndarray]]:
    """The different words in their order, and every text as places in it."""
    words = [t.split() for t in texts]
    spelled = sorted(set().union(*words))
    place = {w: i for i, w in enumerate(spelled)}
    return spelled, [np.fromiter(map(place.__getitem__, some), np.int64, len(some)) for some in words]


def _grams(numbered, n: int, k: int | None) -> list[tuple[str, int]]:
    """The most frequent n-grams and their counts; only these are spelled."""
    spelled, words = numbered
    long = [w for w in words if len(w) >= n]
    if not long:
        return []
    columns = [np.concatenate([w[i:len(w) - n + 1 + i] for w in long]) for i in range(n)]
    code, bound = columns[0], len(spelled)
    for c in columns[1:]:
        if bound * len(spelled) >= 1 << 63:  # only the order of codes matters
            known, code = np.unique(code, return_inverse=True)
            bound = len(known)
        code, bound = code * len(spelled) + c, bound * len(spelled)
    _, at, counts = np.unique(code, return_index=True, return_counts=True)
    best = np.argsort(-counts, kind="stable")[:k]  # a blank is below every letter, so codes are in the order of the spelled n-grams
    rows = zip(*[c[at[best]].tolist() for c in columns])
    return [(" ".join([spelled[i] for i in row]), f) for row, f in zip(rows, counts[best].tolist())]


def _collocations(numbered, top: int | None = 100, k: int | None = 100) -> list[tuple]:
    """(gram, w1, w2, freq, pmi) of the kept bigrams, best first; marginals come from the same kept bigrams."""
    kept = [(g, *g.split(" "), f) for g, f in _grams(numbered, 2, top)]
    total, ends = sum(x[3] for x in kept), Counter()
    for _, a, b, f in kept:
        ends[a] += f
        ends[b] += f
    scored = [(g, a, b, f, math.log2(f / total / ((ends[a] / (total * 2)) * (ends[b] / (total * 2))))) for g, a, b, f in kept]
    return sorted(scored, key=lambda x: (-round(x[4], 6), x[0]))[:k]


def _verb_nouns(pmi: list[tuple], k: int = 50) -> list[tuple]:
    verbs, nouns = tuple(L.PAIR_VERB_SUFFIXES), tuple(L.PAIR_NOUN_SUFFIXES)
    return [x for x in pmi if x[1].endswith(verbs) and (x[2].endswith(nouns) or len(x[2]) > 3)][:k]


def _prepositions(numbered, k: int = 50) -> list[tuple]:
    return [x for x in _grams(numbered, 3, 80) if x[0].split(" ")[1] in L.PHRASE_PREPOSITIONS][:k]


# ---------------------------------------------------------------- tables
def ngrams(df: DataFrame, n: int, k: int | None, key: str = KEY, text: str = "text") -> DataFrame:
    """Top ``k`` n-grams per document."""
    def one(texts) -> dict:
        return _columns([(g, f, i) for i, (g, f) in enumerate(_grams(_numbered(texts), n, k), 1)], ("gram", "freq", "rnk"))

    return _per_document(df, one, {"gram": "string", "freq": "long", "rnk": "int"}, key, text)


def bigram_pmi(df: DataFrame, top: int | None = 100, k: int | None = 100) -> DataFrame:
    """PMI of the ``top`` bigrams of a document."""
    names = {"gram": "string", "w1": "string", "w2": "string", "freq": "long", "pmi": "double", "rnk": "int"}
    return _per_document(df, lambda texts: _columns([(*x, i) for i, x in enumerate(_collocations(_numbered(texts), top, k), 1)], names), names)


def dep_patterns(df: DataFrame) -> DataFrame:
    """Verb-noun pairs, preposition phrases and four-word chains as one table."""
    names = {"kind": "string", "rnk": "int", "pattern": "string", "freq": "long"}

    def one(texts) -> dict:
        words = _numbered(texts)
        found = {"verb_noun": [(x[0], x[3]) for x in _verb_nouns(_collocations(words))], "prep": _prepositions(words), "chain": _grams(words, 4, 50)}
        return _columns([(kind, i, g, f) for kind, some in found.items() for i, (g, f) in enumerate(some, 1)], names)

    return _per_document(df, one, names)


def phrase_hubs(df: DataFrame, k: int | None = 30) -> DataFrame:
    """Words with the most collocations."""
    names = {"word": "string", "degree": "long", "rnk": "int"}

    def one(texts) -> dict:
        degree = Counter(w for x in _collocations(_numbered(texts)) for w in x[1:3])
        return _columns([(w, n, i) for i, (w, n) in enumerate(sorted(degree.items(), key=lambda x: (-x[1], x[0]))[:k], 1)], names)

    return _per_document(df, one, names)


def phrase_graph_stats(df: DataFrame) -> DataFrame:
    """Number of nodes and the entropy of the kept bigram counts."""
    def one(texts) -> dict:
        pmi = _collocations(_numbered(texts))
        if not pmi:
            return {"n_nodes": [], "entropy": []}
        p = np.array([x[3] for x in pmi]) / sum(x[3] for x in pmi)
        return {"n_nodes": [len({w for x in pmi for w in x[1:3]})], "entropy": [-(p * np.log2(p)).sum()]}

    return _per_document(df, one, {"n_nodes": "long", "entropy": "double"})


def phrase_pagerank(df: DataFrame, rounds: int = 30, damping: float = 0.85, top: int | None = None) -> DataFrame:
    """PageRank of each document's own small graph of collocations; with ``top`` the first ranks only."""
    def one(texts) -> dict:
        pmi = _collocations(_numbered(texts))
        if not pmi:
            return {"word": [], "rank": []}
        nodes, idx = np.unique(np.array([x[1:3] for x in pmi]), return_inverse=True)
        idx = idx.reshape(-1, 2)
        src, dst = np.concatenate([idx[:, 0], idx[:, 1]]), np.concatenate([idx[:, 1], idx[:, 0]])
        degree = np.bincount(src, minlength=len(nodes))
        rank = np.full(len(nodes), 1.0 / len(nodes))
        for _ in range(rounds):
            rank = (1 - damping) / len(nodes) + damping * np.bincount(dst, weights=rank[src] / degree[src], minlength=len(nodes))
        best = np.argsort(-np.round(rank, 9), kind="stable")[:top]  # nodes are in the order of their names
        return {"word": nodes[best].astype(object), "rank": rank[best]}

    return _per_document(df, one, {"word": "string", "rank": "double"})


def topic_scores(df: DataFrame) -> DataFrame:
    """Score, coverage and normalised score of every topic, from the words of verb-noun pairs, preposition phrases and collocations."""
    names = {"topic": "string", "score": "long", "matched": "long", "coverage": "double", "normalized": "double"}

    def one(texts) -> dict:
        words = _numbered(texts)
        pmi, weight = _collocations(words), Counter()
        for _, a, b, f, _ in [*_verb_nouns(pmi), *pmi]:
            weight[a] += f
            weight[b] += f
        for gram, f in _prepositions(words):
            head, _, dep = gram.split(" ")
            weight[head] += f
            weight[dep] += f
        rows, total = [], sum(weight.values())
        for topic, keys in L.TOPICS.items() if weight else ():
            hits = [weight[w] for w in set(keys) if w in weight]
            rows.append((topic, sum(hits), len(hits), len(hits) / len(keys), sum(hits) / max(total, 1)))
        return _columns(rows, names)

    return _per_document(df, one, names)


def cooccurrence(df: DataFrame, window: int = 5, top: int | None = 150, k: int | None = 200, key: str = KEY, text: str = "text") -> DataFrame:
    """Unordered pairs of frequent words at most ``window`` tokens apart.

    Each pair is seen from both of its ends, so counts are doubled.
    """
    names = {"word1": "string", "word2": "string", "n": "long", "rnk": "int"}

    def one(texts) -> dict:
        words = [t.lower().split() for t in texts]
        counts = Counter(w for some in words for w in some)
        kept = sorted(w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top])
        place, pairs = {w: i for i, w in enumerate(kept)}, []
        for some in words:
            at = np.array([place.get(w, -1) for w in some], np.int64)
            for step in range(1, min(window, len(at) - 1) + 1):
                a, b = at[:-step], at[step:]
                both = (a >= 0) & (b >= 0)
                pairs.append(np.minimum(a, b)[both] * len(kept) + np.maximum(a, b)[both])
        code, n = np.unique(np.concatenate(pairs or [np.zeros(0, np.int64)]), return_counts=True)
        best = np.argsort(-n, kind="stable")[:k]  # codes are in the order of both words
        spelled = np.array(kept, object)
        return {"word1": spelled[code[best] // max(len(kept), 1)], "word2": spelled[code[best] % max(len(kept), 1)], "n": 2 * n[best],
                "rnk": np.arange(1, len(best) + 1)}

    return map_lists(_texts(df, key, text), [key], [_words("texts")], one, names)


def cohesion(df: DataFrame, span: int = 5, top: int = 100, text: str = "text") -> DataFrame:
    """Mean cosine of each sentence with the next ``span`` sentences, over the frequent words.

    Words of parts too short for a sentence count for the frequencies only.
    """
    def one(sentences, rest) -> dict:
        words = [s.split() for s in sentences]
        counts = Counter(w for some in words for w in some)
        counts.update(w for s in rest for w in s.split())
        place = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top])}
        n = len(words)
        at = np.array([(i, place[w]) for i, some in enumerate(words) for w in some if w in place], np.int64).reshape(-1, 2)
        x = np.bincount(at[:, 0] * top + at[:, 1], minlength=n * top).reshape(n, top).astype(float)
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
        dots = [float((x[:-s] * x[s:]).sum()) for s in range(1, span + 1)]
        pairs = sum(max(n - s, 0) for s in range(1, span + 1))
        return {"n_sentences": [n], "n_pairs": [pairs], "cohesion": [sum(dots) / max(pairs, 1)], "adjacent_mean": [dots[0] / max(n - 1, 1)]}

    parts = _texts(df, KEY, text).select(KEY, F.flatten(F.transform("texts", lambda t: F.transform(F.split(t, T.SENTENCE_BREAK), T.strip))).alias("parts"))
    kept, rest = F.filter("parts", lambda s: F.length(s) > 10), F.filter("parts", lambda s: F.length(s) <= 10)
    return map_lists(parts, [KEY], [_words(kept, F.lower), _words(rest, F.lower)], one, {
        "n_sentences": "long", "n_pairs": "long", "cohesion": "double", "adjacent_mean": "double"})
