"""Linear grouping, importance resampling and whitening against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import grouping, resampling, whitening
from sparkloom.llm.queries import byte_bpe_path

from .test_operators import EXTRA, documents, prose


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *range(9)) for i, t in documents()], "doc_id long, text string, " + EXTRA).repartition(3)


def test_linear_grouping_of_documents(spark, docs):
    from tokenizers import Tokenizer

    tokenizer, length = Tokenizer.from_file(byte_bpe_path()), 256
    want = Counter()
    for i, t in documents():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % length or length
        borders = [0, *range(first, len(ids) + 1, length)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), tuple(ids[a:b].tolist())) for k, (a, b) in enumerate(zip(borders, borders[1:])))
    got = grouping.pack_documents(docs, byte_bpe_path(), end_id=0, length=length, group_pieces=60).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= length
    assert len(by_sequence) <= best_fit_decreasing([r.length for r in got], length) + 2 * math.ceil(len(got) / 60)
    thin = grouping.pack_documents(docs, byte_bpe_path(), with_ids=False)
    assert thin.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert grouping.pack_documents(docs.limit(0), byte_bpe_path()).count() == 0


def best_fit_decreasing(sizes, length):
    free = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b, f in enumerate(free) if f >= size]
        b = min(fits, key=lambda b: free[b]) if fits else len(free)
        if not fits:
            free.append(length)
        free[b] -= size
    return len(free)


@pytest.mark.parametrize("seed", range(8))
def test_groups_need_about_as_few_sequences_as_best_fit(seed):
    r = np.random.default_rng(seed)
    kinds = [r.integers(1, 257, 900), np.minimum(256, r.lognormal(4.2, 0.9, 900).astype(int) + 1), r.choice([97, 64, 130, 256], 700), np.full(50, 129),
             np.concatenate((r.integers(86, 170, 600), r.integers(1, 20, 200))), np.array([256]), np.array([1]), r.integers(65, 129, 900)]
    sizes = kinds[seed].astype(np.int64)
    plan = grouping.make_plan(np.bincount(sizes, minlength=257), 256, 24)
    bins, offsets = grouping.pack_group(sizes, plan)
    load = np.bincount(bins, weights=sizes)
    assert load.max() <= 256 and load.min() > 0
    for b in range(len(load)):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert offsets[at].tolist() == (np.cumsum(sizes[at]) - sizes[at]).tolist()
    assert len(load) <= best_fit_decreasing(sizes.tolist(), 256) * 1.02 + 2


def test_size_groups_hold_equal_shares():
    counts = np.bincount(np.random.default_rng(1).integers(60, 200, 5000), minlength=257)
    sizes = grouping.equal_groups(counts, 65, 10)
    shares = [counts[a + 1:b + 1].sum() for a, b in zip(sizes[1:], sizes[:-1])] + [counts[65:sizes[-1] + 1].sum()]
    assert sizes[0] == 199 and len(sizes) == 10 and max(shares) - min(shares) < 150 and sum(shares) == counts[65:].sum()
    assert len(grouping.equal_groups(counts * 0, 65, 10)) == 0


def test_configurations_reach_the_linear_optimum():
    """Sizes 6, 4, 3 in room 10: 6+4 and 3+3+3 or 4+3+3 leave the known optimum."""
    configs, used = grouping.configurations(np.array([6, 4, 3]), np.array([10.0, 20.0, 30.0]), 10)
    assert (configs @ np.array([6, 4, 3]) <= 10).all() and (configs.T @ used >= np.array([10, 20, 30]) * (1 - 1e-5)).all()
    assert abs(used.sum() - (10 + 10 + 10 / 3)) < 0.01


def brute_resampling(rows, target, n, percent, least, buckets=10_000):
    def words(t):
        return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]

    def grams(t):
        w = words(t)
        return [zlib.crc32(b" ".join(w[i:i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(g for _, x in rows for g in grams(x)), Counter(g for x in target for g in grams(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in rows:
        g = grams(x)
        weight = math.floor(sum(map(gain, g)) / len(g)) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[:len(fit) * percent // 100], 1):
        x[5] = k
    return Counter(map(tuple, out))


@pytest.mark.parametrize("n, percent, least", [(1, 10, 20), (3, 40, 1), (2, 100, 0), (1, 0, 20)])
def test_resampling(spark, docs, n, percent, least):
    target = [prose(70, 999), prose(30, 2), None, ""]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, bench, n=n, percent=percent, min_words=least)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_resampling(documents(), target, n, percent, least)


def test_resampling_of_empty_tables_and_ties(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert resampling.resample(none, bench).count() == 0
    same = [(5, "a b c"), (5, "a b c"), (4, "x " * 30), (None, "a b c")] + [(7, "one and the same row")] * 300
    docs = spark.createDataFrame(same, "doc_id long, text string")
    got = resampling.resample(docs, bench, percent=100, min_words=1).collect()
    assert sorted(r.rank for r in got) == list(range(1, len(same) + 1))
    assert [r.score for r in sorted(got, key=lambda r: r.rank)] == sorted((r.score for r in got), reverse=True)
    assert resampling.resample(docs, bench.limit(0), percent=50, min_words=1).where("rank IS NOT NULL").count() == len(same) // 2
    drawn = resampling.draw(docs.withColumn("rank", docs.doc_id), bench, percent=100, min_words=4)
    assert drawn.columns == ["doc_id", "text", "rank"] and drawn.count() == 301


def brute_whitening(rows, k):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    c = ((n * x - sums) / n).astype(float)
    v = c.T @ c / n
    e, z = np.linalg.eigh(v)
    e, z = e[::-1], z[:, ::-1]
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    return deviation, c @ z[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


@pytest.mark.parametrize("dims, k, extra", [(24, 6, 4), (24, 6, 100), (5, 32, 24), (1, 3, 1), (40, 30, 5)])
def test_whitening(spark, dims, k, extra):
    r = np.random.default_rng(dims + k)
    x = r.normal(size=(400, dims)) * np.linspace(3, 0.5, dims) + r.normal(size=(1, dims)) * 4
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(3, [float(c) for c in x[3]]), (None, [float(c) for c in x[5]])]
    bad = [(900, None), (901, []), (902, [float("nan")] * dims), (903, [float("inf")] + [1.0] * (dims - 1)), (904, [None] + [1.0] * (dims - 1)), (905, [1e300] * dims), (906, [1.0] * (dims + 1))]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id long, embedding array<double>, n int, x int").repartition(3)
    got = whitening.whiten(df, components=k, extra=extra).collect()
    deviation, white, explained = brute_whitening(rows, k)
    assert len(got) == len(rows) * white.shape[1] and {r.n for r in got} == {len(rows)} and max(r.identity_error for r in got) < 1e-9
    at = {i: j for j, (i, _) in enumerate(rows)}
    signs = {}
    for r in got:
        w = white[at[r.vec_id], r.component - 1]
        if abs(w) > 0.1:
            signs.setdefault(r.component, set()).add(np.sign(w) == np.sign(r.whitened))
        assert abs(abs(w) - abs(r.whitened)) < 1e-7 and r.deviation == deviation[at[r.vec_id]] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_tied_flat_and_empty_vectors(spark):
    """Directions without variance are no components; a tie of eigenvalues still gives an orthonormal basis."""
    schema = "vec_id long, embedding array<double>"
    corners = [(i, [float((i >> b & 1) * 2) for b in range(4)] + [7.0, 0.0]) for i in range(16)]
    got = whitening.whiten(spark.createDataFrame(corners, schema), components=6, extra=1).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and max(r.identity_error for r in got) < 1e-9 and all(abs(r.explained - 0.25) < 1e-9 for r in got)
    for rows in ([(i, [1.0, 2.0]) for i in range(5)], [(1, [3.0, 4.0])], [(1, None)], []):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    far = [(0, [1e13, 0.0]), (1, [-1e13, 1.0]), (2, [0.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(far, schema)).collect()
    assert {r.deviation for r in got if r.vec_id < 2} == {None} and len(got) in (3, 6)


def test_chebyshev_passes_grow_the_wanted_directions_only(spark):
    """A block narrower than the space is certified by filters of several passes."""
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 32)) * np.linspace(2, 1, 32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = whitening.to_integers(df).cache()
    model = whitening.fit(rows, 32, components=8, extra=8)
    full = whitening.fit(rows, 32, components=8, extra=24)
    assert model.passes > 8 > full.passes and model.vectors.shape == (32, 8)
    assert np.abs(np.abs((model.vectors * full.vectors).sum(axis=0)) - 1).max() < 1e-12
