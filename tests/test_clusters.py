"""Clusters of many groups, graph rounds with hot keys and the permutation test against sequential algorithms."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.catalog.classification import TCOS
from sparkloom.catalog.graphs import edges
from sparkloom.operators import clusters as K
from sparkloom.operators import graph as G
from sparkloom.operators import sequence as Q
from sparkloom.operators import stats as ST
from sparkloom.plans.joins import join_spread


def sequential_lloyd(points, starts, rounds):
    centres, last = [list(points[i]) for i in starts], None
    for _ in range(rounds):
        last = [min(range(len(centres)), key=lambda c: (round(sum((a - b) ** 2 for a, b in zip(p, centres[c])), 9), c)) for p in points]
        for c in range(len(centres)):
            mine = [p for p, a in zip(points, last) if a == c]
            if mine:
                centres[c] = [sum(x) / len(mine) for x in zip(*mine)]
    return last, centres


def digest(group, item):
    return hashlib.md5(f"42:{group}:{item}".encode()).hexdigest()


def test_sentence_clusters_of_every_document(spark):
    r = random.Random(3)
    words = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    docs = {d: [" ".join(r.choices(words[:12] if i % 2 else words[8:], k=r.randint(3, 9))) for i in range(n)] for d, n in ((1, 40), (2, 12), (3, 2), (4, 1), (5, 25))}
    rows = [(d, i, s) for d, sents in docs.items() for i, s in enumerate(sents)] + [(5, 25, "!!! ???")]
    docs[5].append("")
    sents = spark.createDataFrame(rows, "doc_id long, sent_idx int, sentence string").repartition(3)
    got = {(x.doc_id, x.cluster): (x["size"], x.intra_distance) for x in K.sentence_clusters(sents, top=15).collect()}
    want = {}
    for d, sents_of in docs.items():
        freq = Counter(w for s in sents_of for w in s.split())
        vocabulary = sorted(freq, key=lambda w: (-freq[w], w))[:15]
        points = []
        for s in sents_of:
            v = [float(s.split().count(w)) for w in vocabulary]
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            points.append([x / norm for x in v])
        k = min(5, max(2, len(points) // 10))
        if len(points) < k:
            continue
        starts = sorted(range(len(points)), key=lambda i: digest(d, i))[:k]
        found, centres = sequential_lloyd(points, starts, 20)
        for c in set(found):
            mine = [p for p, a in zip(points, found) if a == c]
            want[d, c] = (len(mine), math.sqrt(sum(sum((a - b) ** 2 for a, b in zip(p, centres[c])) for p in mine) / len(mine)))
    assert set(got) == set(want) and {d for d, _ in got} == {1, 2, 3, 5}
    for key, (size, far) in want.items():
        assert got[key][0] == size and got[key][1] == pytest.approx(far, abs=1e-6)
    significant = {x.doc_id: x for x in K.cluster_significance(sents, permutations=50).collect()}
    assert significant[1].p_value < 0.1 and significant[1].observed_intra < significant[1].perm_mean and 4 not in significant
    assert all(0 <= x.p_value <= 1 and x.significant == (x.p_value < 0.05) for x in significant.values())
    assert K.sentence_clusters(sents.limit(0)).count() == 0


def test_tightness_is_the_weighted_mean_distance():
    r = np.random.default_rng(2)
    x, labels = r.normal(size=(30, 4)), r.integers(0, 3, (5, 30))
    for row, got in zip(labels, K.tightness(x, labels, 3)):
        want = 0.0
        for c in range(3):
            mine = x[row == c]
            want += len(mine) * math.sqrt(((mine - mine.mean(axis=0)) ** 2).sum(axis=1).mean()) if len(mine) else 0
        assert got == pytest.approx(want / 30)


# ---------------------------------------------------------------- graphs
def frame(spark, pairs):
    return spark.createDataFrame([(a, b, float((a * 31 + b * 17) % 97 + 1)) for a, b in pairs], "src long, dst long, weight double")


def union_find(pairs):
    root = {v: v for p in pairs for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


GRAPHS = {
    "star": [(7, i) for i in range(8, 300)], "path": [(i, i + 1) for i in range(200)], "clique": [(i, j) for i in range(30) for j in range(i)],
    "loops": [(1, 1), (2, 3), (3, 2), (9, 9)], "mixed": [(i, (i * 7919) % 211) for i in range(150)] + [(1000 + i, 1001 + i) for i in range(50)]}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_components_by_contraction(spark, name):
    got = {r.node: r.label for r in G.connected_components(frame(spark, GRAPHS[name])).collect()}
    assert got == union_find(GRAPHS[name])


def test_components_of_no_edges_and_of_texts(spark):
    assert G.connected_components(frame(spark, [(1, 2)]).limit(0)).count() == 0
    pairs = spark.createDataFrame([("b", "a", 0.1), ("c", "b", 0.2), ("x", "y", 0.3), ("p", "q", 0.9)], "a string, b string, d double")
    assert {r.node: r.label for r in G.threshold_clusters(pairs, "a", "b", "d", 0.5).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


@pytest.mark.parametrize("rows_per_part", [3, 10_000])
def test_join_of_a_hot_key(spark, rows_per_part):
    df = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(300)], "k int, i int")
    lookup = spark.createDataFrame([(k, k * 10) for k in range(250)], "k int, v int")
    for how in ("inner", "left"):
        got = Counter(map(tuple, join_spread(df, lookup, "k", "i", how, rows_per_part).select("k", "i", "v").collect()))
        assert got == Counter(map(tuple, df.join(lookup, "k", how).select("k", "i", "v").collect()))


def test_vertex_cut_spreads_a_hub(spark):
    """A third of all links leave one source: the largest partition holds little more than an even share."""
    pairs = [(0, i) for i in range(1, 2001)] + [(5000 + i, 9000 + (i * 7) % 1500) for i in range(2000)]
    df = frame(spark, pairs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    count = lambda part: [r["count"] for r in part.groupBy(F.spark_partition_id()).count().collect()]
    ordinary, hubs = map(count, G.rank_links(df, hub_degree=100))
    whole, none = map(count, G.rank_links(df, hub_degree=10**9))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(ordinary) + sum(hubs) == sum(whole) == 8000 and not none and max(whole) > 2500
    assert sum(hubs) == 2000 and max(hubs) < 1.4 * 2000 / 4 and max(ordinary) < 1.4 * 6000 / 4
    few = {r.node: r.rank for r in G.pagerank(df, 0.85, 10, None, hub_degree=100).collect()}
    none = {r.node: r.rank for r in G.pagerank(df, 0.85, 10, None, hub_degree=10**9).collect()}
    assert few.keys() == none.keys() and all(few[v] == pytest.approx(none[v]) for v in few) and sum(few.values()) == pytest.approx(1)


def test_spanning_forest_has_kruskals_weight(spark, sf):
    rows = {}
    for r in edges(spark, sf).collect():
        rows[r.src, r.dst] = float(r.weight)
    root = {v: v for p in rows for v in p}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    total = count = 0
    for (a, b), w in sorted(rows.items(), key=lambda x: x[1]):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            total, count = total + w, count + 1
    s = G.mst_summary(G.mst(edges(spark, sf)), spark.createDataFrame([(len(root),)], "n_nodes long")).first()
    assert s.n_edges == count and float(s.total_weight) == pytest.approx(total) and s.is_connected == (count == len(root) - 1)


# ---------------------------------------------------------------- permutations
@pytest.mark.parametrize("per_bucket", [1, 7, 10_000])
def test_permutations_by_selection_are_those_of_full_ranking(spark, per_bucket):
    r = np.random.default_rng(5)
    rows = [(i, "a" if r.random() < 0.3 else "b", float(r.normal() + (i % 2))) for i in range(150)]
    got = ST.permutation_test(spark.createDataFrame(rows, "id long, g string, x double"), "g", "a", "x", "id", 20, per_bucket=per_bucket).first()
    na, total = sum(g == "a" for _, g, _ in rows), sum(x for *_, x in rows)
    observed = abs(np.mean([x for _, g, x in rows if g == "a"]) - np.mean([x for _, g, x in rows if g != "a"]))
    diffs = []
    for rep in range(1, 21):
        order = sorted(rows, key=lambda q: ((int(hashlib.md5(f"perm:{rep}:{q[0]}".encode()).hexdigest()[:8], 16) + 1) / 2**32, q[0]))
        mine = sum(x for *_, x in order[:na])
        diffs.append(abs(mine / na - (total - mine) / (150 - na)))
    assert got.permutations == 20 and got.observed == pytest.approx(observed) and got.perm_mean == pytest.approx(np.mean(diffs))
    assert got.p_value == pytest.approx(np.mean(np.array(diffs) >= observed))


# ---------------------------------------------------------------- sequences
def test_kmers_of_any_letters(spark):
    r = random.Random(1)
    texts = ["".join(r.choices("ACGTN", k=n)) for n in (0, 1, 2, 5, 90)] + ["éaé\U0001F600aé" * 3, None, "AAAA"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string")
    for k in (1, 3, 9):
        got = {(x.seq_id, x.kmer): x.n for x in Q.kmers(df, k).collect()}
        assert got == {(i, m): n for i, t in enumerate(texts) for m, n in Counter((t or "")[j:j + k] for j in range(len(t or "") - k + 1)).items()}


def test_autocorrelation_by_fft_is_the_lagged_product(spark):
    r = random.Random(2)
    texts = ["".join(r.choices("ACGT", weights=(5, 1, 1, 3), k=n)) for n in (1, 2, 3, 40, 333)] + ["ACGT" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string")
    got = {(x.seq_id, x.lag): (x.correlation, x.peak) for x in Q.autocorrelation(df, 50).collect()}
    n_rows = 0
    for i, t in enumerate(texts):
        y = Q._walk(t)[1]
        y = y - y.mean()
        var = float((y * y).mean()) or 1.0
        c = [float((y[:len(y) - g] * y[g:]).sum() / ((len(y) - g) * var)) for g in range(1, min(50, len(y) // 2) + 1)]
        n_rows += len(c)
        for g, v in enumerate(c, 1):
            assert got[i, g][0] == pytest.approx(v, abs=1e-9)
    assert len(got) == n_rows and any(p for _, p in got.values())


# ---------------------------------------------------------------- clusters of terms
def test_linked_labels_by_rounds(spark):
    chain = [(1, f"t{i:02d}", f"t{i + 1:02d}") for i in range(40)] + [(2, "b", "a"), (2, "c", "b"), (2, "y", "x"), (3, "k", "k")]
    df = spark.createDataFrame(chain, "doc long, a string, b string")
    some = {(r.doc, r.item): r.label for r in K.linked_labels(df, "doc", "a", "b", 20).collect()}
    every = {(r.doc, r.item): r.label for r in K.linked_labels(df, "doc", "a", "b").collect()}
    assert all(some[1, f"t{i:02d}"] == f"t{max(0, i - 20):02d}" and every[1, f"t{i:02d}"] == "t00" for i in range(41))
    assert some.items() >= {(2, "c"): "a", (2, "y"): "x", (3, "k"): "k"}.items() and len(some) == len(every) == 47


def test_long_chains_of_terms_as_in_the_sql(spark, tmp_path):
    """Terms with words used once between them are linked in chains longer than the rounds of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    terms = [f"{a}{b}n{s}" for a in "bcdf" for b in "aeiou" for s in ("ful", "ing", "lity", "ly")]
    spaced = " ".join(f"{t} w{i}lity x{i}lity" for i, t in enumerate(terms))  # within the window of a term: its two neighbours
    texts = [(1, " ".join([spaced, *[f"v{i}lity" for i in range(9)], spaced.replace("w", "y").replace("x", "z")])), (2, " ".join(terms)), (3, "one two one two"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    queries, oracles = catalog.load()
    want = sorted(con.execute(oracles["NS-04"]).fetchall())
    assert sorted(map(tuple, queries["NS-04"](spark, str(tmp_path)).collect())) == want and len(want) > 2


def test_all_links_of_terms_count(spark, tmp_path):
    """Every pair within the distance links its terms: pairs beyond the hundred best, and chains of more than 20 terms."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(6)
    terms = [f"{a}{b}n{s}" for a in "bcdf" for b in "aeiou" for s in ("ful", "ing", "lity", "ly")]
    spaced = " ".join(f"{t} w{i}lity x{i}lity" for i, t in enumerate(terms))
    chain = " ".join([spaced, *[f"v{i}lity" for i in range(9)], spaced.replace("w", "y").replace("x", "z")])
    mixed = " . ".join(" ".join(r.choices(terms[lo:lo + 20], k=200)) for lo in (0, 20, 40, 60))
    spark.createDataFrame([(1, chain), (2, mixed)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    pairs = con.execute(f"""WITH {TCOS} SELECT a.doc_id, a.term, b.term FROM cn a JOIN cn b ON a.doc_id = b.doc_id AND a.ctx = b.ctx AND a.term < b.term
        GROUP BY ALL HAVING 1 - round(sum(a.x * b.x), 6) <= 0.8""").fetchall()
    home = {(d, t): (d, t) for d, a, b in pairs for t in (a, b)}
    for _ in range(len(home)):
        for d, a, b in pairs:
            home[d, a] = home[d, b] = min(home[d, a], home[d, b])
    want = sorted((*label, n) for label, n in Counter(home.values()).items())
    queries, oracles = catalog.load()
    assert sorted(map(tuple, queries["NS-04"](spark, str(tmp_path)).collect())) == want == sorted(con.execute(oracles["NS-04"]).fetchall())
    assert Counter(d for d, *_ in pairs)[2] > 100


def test_permutations_draw_once_and_widen_the_limits(spark, monkeypatch):
    """Rows near the cut are ranked, not rows times permutations; one group only and no rows at all give what the SQL gives."""
    near = []
    plain = ST.cut
    monkeypatch.setattr(ST, "cut", lambda df: (out := plain(df), near.append(out.count()))[0])
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 10).cast("double").alias("x"))
    assert ST.permutation_test(df, "g", "a", "x", "id", 20, per_bucket=1).first().permutations == 20
    assert max(near) < 20 * 8 * 2 * 20_000 ** 0.5
    wide = ST.permutation_test(df, "g", "a", "x", "id", 20, per_bucket=10**6).first()
    monkeypatch.setattr(ST.math, "sqrt", lambda _: 0.0)
    assert ST.permutation_test(df, "g", "a", "x", "id", 20, per_bucket=1).first() == wide
    assert ST.permutation_test(df.where("g = 'a'"), "g", "a", "x", "id", 5).first().asDict() == {"observed": None, "perm_mean": None, "p_value": 0.0, "permutations": 5}
    assert ST.permutation_test(df.limit(0), "g", "a", "x", "id", 5).first().permutations == 0
