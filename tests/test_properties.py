"""Brute-force and property checks of operators on small hand-made inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import lexicon as L
from sparkloom.functions import text as T
from sparkloom.functions.draws import normal, uniform
from sparkloom.functions.numeric import norm_cdf
from sparkloom.operators import analysis as A
from sparkloom.operators import classify as C
from sparkloom.operators import dataflow as D
from sparkloom.operators import graph as G
from sparkloom.operators import logs as LG
from sparkloom.operators import matrix as M
from sparkloom.operators import quality as Q
from sparkloom.operators import raster as R
from sparkloom.operators import sequence as S
from sparkloom.operators import stats as ST
from sparkloom.operators import tokens as TK
from sparkloom.operators.wordcount import reducer_of
from sparkloom.plans.joins import join_lookup
from sparkloom.plans.ordered import carry_forward, islands, neighbour, quantile_blocks, row_numbers, running_sums
from sparkloom.streaming import flows as W

PROSE = ("Alan Turing met Dr Smith Jones at Acme Widget Company in 1950. It was a very good and not bad idea! "
         "The NASA team quickly realised that computing machines are powerful. Don't worry; O'Neil's 'quoted' word is fine. "
         "Google and BERT models process language data. Don't stop.")


@pytest.fixture(scope="module")
def prose(spark):
    return spark.createDataFrame([(1, PROSE), (2, "Short."), (3, "")], "doc_id long, text string").cache()


# ---------------------------------------------------------------- ordered helpers, one hot key
@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(5)
    rows = [("hot", i, rng.choice([None, *"abc"]), rng.randint(0, 9)) for i in rng.sample(range(3000), 900)]
    rows += [("cold", i, "z", 1) for i in range(5)]
    return spark.createDataFrame(rows, "k string, t int, s string, v int").cache()


def _sorted(hot, key):
    return sorted(((r.t, r.s, r.v) for r in hot.collect() if r.k == key))


@pytest.mark.parametrize("width", [1, 37, 100000])
def test_running_sums_and_row_numbers(hot, width):
    block = F.floor(F.col("t") / width)
    got = {(r.k, r.t): (r.c, r.rn) for r in row_numbers(
        running_sums(hot, ["k"], [F.col("t")], {"c": F.col("v")}, block).drop("__block"), ["k"], [F.col("t")], block).collect()}
    for key in ("hot", "cold"):
        total = 0
        for i, (t, _, v) in enumerate(_sorted(hot, key), 1):
            total += v
            assert got[key, t] == (total, i)


@pytest.mark.parametrize("width", [1, 37, 100000])
def test_neighbour_and_carry_forward(hot, width):
    block = F.floor(F.col("t") / width)
    lag = {(r.k, r.t): r.p for r in neighbour(hot, ["k"], ["t"], {"p": "t"}, -1, block).collect()}
    lead = {(r.k, r.t): r.p for r in neighbour(hot, ["k"], ["t"], {"p": "s"}, 1, block).collect()}
    carried = {(r.k, r.t): r.c for r in carry_forward(hot, ["k"], ["t"], "s", "c", block).collect()}
    rows = _sorted(hot, "hot")
    seen = None
    for i, (t, s, _) in enumerate(rows):
        seen = s if s is not None else seen
        assert lag["hot", t] == (rows[i - 1][0] if i else None)
        assert lead["hot", t] == (rows[i + 1][1] if i + 1 < len(rows) else None)
        assert carried["hot", t] == seen


def test_islands_equal_density_clusters(hot):
    got = {}
    for r in islands(hot, ["k"], ["t"], "t", 6, F.floor(F.col("t") / 50)).where("k = 'hot'").collect():
        got.setdefault(r.island, []).append(r.t)
    want, prev = [], None
    for t, _, _ in _sorted(hot, "hot"):
        if prev is None or t - prev > 6:
            want.append([])
        want[-1].append(t)
        prev = t
    assert sorted(sorted(v) for v in got.values()) == want


def test_percentiles_exact_on_ties(spark):
    rng = random.Random(1)
    data = [rng.choice([1.0, 2.0, 2.0, 5.5, rng.random() * 10]) for _ in range(501)]
    df = spark.createDataFrame([("a", x) for x in data] + [("b", 3.0)], "k string, x double")
    got = {r.k: r for r in ST.percentiles(df, ["k"], "x", [0.05, 0.5, 0.99]).collect()}
    for i, p in enumerate([5, 50, 99]):
        assert got["a"][f"q{i}"] == pytest.approx(np.percentile(data, p))
        assert got["b"][f"q{i}"] == 3.0


# ---------------------------------------------------------------- text
def test_word_pattern_equals_python_on_ascii(prose):
    rows = {r.doc_id: r.w for r in prose.select("doc_id", T.word_array(F.col("text")).alias("w")).collect()}
    assert rows[1] == re.findall(r"\b[a-zA-Z0-9']+\b", PROSE)
    assert rows[3] == []


def test_words_touching_other_letters_are_not_words(spark):
    df = spark.createDataFrame([("naïve été_x abc déjà l'ete don't",)], "t string")
    assert df.select(T.word_array(F.col("t"))).first()[0] == ["abc", "l'ete", "don't"]


def test_sentences_equal_python(prose):
    rows = [r.sentence for r in TK.sentences(prose).where("doc_id = 1").orderBy("sent_idx").collect()]
    want = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", PROSE) if len(s.strip()) > 10]
    assert rows == want


def test_cooccurrence_brute_force(prose):
    toks = [w.lower() for w in re.findall(r"\b[a-zA-Z0-9']+\b", PROSE)]
    want = Counter()
    for i, a in enumerate(toks):
        for j in range(max(0, i - 5), min(len(toks), i + 6)):
            if i != j:
                want[tuple(sorted((a, toks[j])))] += 1
    got = {(r.word1, r.word2): r.n for r in TK.cooccurrence(prose, 5, None, None).where("doc_id = 1").collect()}
    assert got == dict(want)


def test_entities(prose):
    got = {(r.text, r.type) for r in A.entities(TK.sentences(prose)).collect()}
    assert ("Alan Turing", "PERSON") in got and ("Google", "ORG") in got and ("Bert", "TECH") in got
    assert ("Dr Smith Jones", "PERSON") in got and ("Acme Widget Company", "ORG") in got
    assert ("1950", "DATE") in got and ("NASA", "ACRONYM") in got


def test_sentiment_of_handmade_context(spark):
    uni = spark.createDataFrame([(1, "x", "ORG", "X", 1)], "doc_id long, entity string, type string, text string, mentions long")
    ctx = spark.createDataFrame([(1, "x", w, n) for w, n in (("good", 2), ("bad", 1), ("very", 1), ("not", 1), ("table", 4))],
                                "doc_id long, entity string, word string, n long")
    r = C.entity_sentiment(uni, ctx).first()
    assert (r.net, r.adjusted, r.context_size) == (1, -1.5, 9)


def test_reading_rules_and_syllables(spark):
    df = spark.createDataFrame([("table",), ("make",), ("rhythm",), ("Idea",), ("be",)], "w string")
    assert [r[0] for r in df.select(T.syllables(F.col("w"))).collect()] == [2, 1, 1, 2, 1]


def test_reducer_is_big_integer_mod(spark):
    import hashlib

    words = ["a", "über", "the", "zebra"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(reducer_of(F.col("w"), 7)).collect()]
    assert got == [int(hashlib.sha256(w.encode()).hexdigest(), 16) % 7 for w in words]


# ---------------------------------------------------------------- sequences
def _orfs(seq, min_length=75):
    code = {}
    for i, a in enumerate(L.GENETIC_CODE):
        code[L.GENETIC_CODE_ORDER[i // 16] + L.GENETIC_CODE_ORDER[i // 4 % 4] + L.GENETIC_CODE_ORDER[i % 4]] = a
    out = set()
    for frame in range(3):
        aas = [code[seq[i:i + 3]] for i in range(frame, len(seq) - 2, 3)]
        i = 0
        while i < len(aas):
            if aas[i] == "M":
                j = i
                while j < len(aas) and aas[j] != "*":
                    j += 1
                if j < len(aas) and (j - i) * 3 >= min_length:
                    out.add((frame, frame + 3 * i, frame + 3 * j + 3, "".join(aas[i:j])[:20]))
                i = j
            i += 1
    return out


def test_orfs_equal_direct_scan(spark):
    rng = random.Random(9)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 2, 3, 900, 4001, 7000])]
    df = spark.createDataFrame(seqs, "seq_id long, sequence string")
    got = {}
    for r in S.find_orfs(df, 75).collect():
        got.setdefault(r.seq_id, set()).add((r.frame, r.start, r.end, r.preview))
    for i, s in seqs:
        assert got.get(i, set()) == _orfs(s)


def test_kmers_and_positional_frequency(spark):
    rng = random.Random(2)
    s = "".join(rng.choice("ACGT") for _ in range(333))
    df = spark.createDataFrame([(1, s)], "seq_id long, sequence string")
    assert {r.kmer: r.n for r in S.kmers(df, 4).collect()} == dict(Counter(s[i:i + 4] for i in range(330)))
    got = {r.position: r for r in S.positional_freq(df, 50).collect()}
    step = 333 // 50
    for pos in range(50):
        sample = [s[o + pos] for o in range(0, 333 - pos, step)]
        for b in "ACGT":
            assert got[pos][b] == pytest.approx(sample.count(b) / len(sample))


def test_isochores_are_single_linkage(spark):
    rng = random.Random(3)
    pts = [(rng.random(), rng.random()) for _ in range(40)]
    seg = spark.createDataFrame([(1, x, y) for x, y in pts], "seq_id long, gc double, complexity double")
    parent = list(range(40))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(40):
        for j in range(i):
            if math.dist([round(c, 6) for c in pts[i]], [round(c, 6) for c in pts[j]]) <= 0.12:
                parent[root(i)] = root(j)
    want = sorted(n for n in Counter(root(i) for i in range(40)).values() if n > 1)
    assert sorted(r.n_segments for r in S.isochores(seg, 0.12).collect()) == want


def test_interval_pairs_brute_force(spark):
    rng = random.Random(4)
    cl = []
    for _ in range(60):
        a = rng.randint(0, 20000)
        cl.append((1, a, a + rng.randint(50, 4000)))
    df = spark.createDataFrame(cl, "seq_id long, start long, end long")
    want = sorted((a[1], b[1], b[1] - a[2]) for a in cl for b in cl if b[1] > a[1] and b[1] - a[2] < 1000)
    assert sorted((r.start_a, r.start_b, r.gap) for r in S.interval_pairs(df, 1000).collect()) == want


def test_mean_pair_similarity(spark):
    xs = [0.1, 0.5, 0.5, 0.9, 0.25]
    df = spark.createDataFrame([(1, x) for x in xs], "seq_id long, x double")
    want = np.mean([1 - abs(a - b) for i, a in enumerate(xs) for b in xs[:i]])
    assert S.mean_pair_similarity(df, "x").first().mean_similarity == pytest.approx(want)


# ---------------------------------------------------------------- graphs
@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(7)
    e = {}
    for _ in range(140):
        a, b = rng.randint(0, 59), rng.randint(0, 59)
        if a != b:
            e[min(a, b), max(a, b)] = float(rng.randint(1, 30))
    e[100, 101] = 1.0
    rows = [(a, b, w) for (a, b), w in e.items()]
    return rows, spark.createDataFrame(rows, "src long, dst long, weight double").cache()


def _kruskal(rows):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    total = n = 0
    for a, b, w in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            total, n = total + w, n + 1
    comps = {}
    for x in list(parent):
        comps.setdefault(root(x), set()).add(x)
    return total, n, comps


def test_mst_and_components_against_kruskal(graph):
    rows, df = graph
    total, n, comps = _kruskal(rows)
    tree = G.mst(df).collect()
    assert (sum(r.weight for r in tree), len(tree)) == (total, n)
    got = {}
    for r in G.connected_components(df).collect():
        got.setdefault(r.label, set()).add(r.node)
    assert got == {min(c): c for c in comps.values()}


def test_pagerank_mass_and_bfs(graph):
    rows, df = graph
    nodes = {x for r in rows for x in r[:2]}
    pr = {r.node: r["rank"] for r in G.pagerank(df, iters=100, tol=1e-9).collect()}
    assert set(pr) == nodes and sum(pr.values()) == pytest.approx(1.0)
    adj = {}
    for a, b, _ in rows:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    fixed = {v: 0.15 / len(nodes) + 0.85 * sum(pr[u] / len(adj[u]) for u in adj[v]) for v in nodes}
    assert max(abs(fixed[v] - pr[v]) for v in nodes) < 1e-6
    dist, frontier = {100: 0}, [100]
    while frontier:
        nxt = []
        for u in frontier:
            for v in adj[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    nxt.append(v)
        frontier = nxt
    assert {r.node: r.depth for r in G.bfs(df, 100).collect()} == dist


def test_registered_pagerank_is_converged_for_all_nodes(spark, sf):
    from sparkloom.catalog import load

    adj = {}
    for part, order in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_orderkey").collect():
        adj.setdefault(part * 2, set()).add(order * 2 + 1)
        adj.setdefault(order * 2 + 1, set()).add(part * 2)
    want, rounds, diff = {v: 1 / len(adj) for v in adj}, 0, 1.0
    while rounds < 100 and diff >= 1e-6:
        new = {v: 0.15 / len(adj) + 0.85 * sum(want[u] / len(adj[u]) for u in adj[v]) for v in adj}
        diff, want, rounds = sum(abs(new[v] - want[v]) for v in adj), new, rounds + 1
    got = load()[0]["GR-02-converged"](spark, sf).collect()
    assert len(got) == len(adj) and rounds <= got[0].iterations < rounds + 5
    assert sum(abs(r["rank"] - want[r.node]) for r in got) < 1e-5


def test_adjacency_chunks_keep_all_neighbours(graph):
    rows, df = graph
    got = {}
    for r in G.adjacency(df, 3).collect():
        got.setdefault(r.src, []).extend(r.neighbours)
    want = {}
    for a, b, _ in rows:
        want.setdefault(a, []).append(b)
        want.setdefault(b, []).append(a)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


# ---------------------------------------------------------------- matrices and statistics
@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = 1.5 + x @ np.array([2.0, -1.0, 0.5]) + rng.normal(scale=0.3, size=400)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, id=range(400))
    return pdf, spark.createDataFrame(pdf).cache()


def test_ols_and_ridge(table):
    pdf, df = table
    r = M.ols(df, "y", ["a", "b", "c"]).first()
    X = np.column_stack([np.ones(400), pdf[["a", "b", "c"]]])
    beta = np.linalg.lstsq(X, pdf["y"], rcond=None)[0]
    assert np.allclose(r.coefficients, beta)
    assert r.r2 == pytest.approx(1 - ((pdf.y - X @ beta) ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum())
    folds = M.kfold_ridge(df, "y", ["a", "b", "c"], F.col("id"), 4).collect()
    assert len(folds) == 4 and all(f.r2 > 0.9 for f in folds)


def test_gram_and_eigen(table):
    pdf, df = table
    m = pdf[["a", "b", "c"]].to_numpy()
    vec = df.select(F.array("a", "b", "c").alias("v"))
    g = {(r.i, r.j): r.v for r in M.gram(vec, "v").collect()}
    want = m.T @ m
    assert all(g[i, j] == pytest.approx(want[i, j]) for i in range(3) for j in range(i, 3))
    e = [r.eigenvalue for r in M.top_eigen(M.covariance(vec, "v"), 3).orderBy("rank").collect()]
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(np.corrcoef(m.T)))[::-1])


def test_mann_whitney_brute_force(spark):
    rng = random.Random(6)
    rows = [("w", rng.choice("ab"), float(rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, g string, x double")
    r = ST.mann_whitney(df, ["k"], "g", "a", "x").first()
    a, b = [x for _, g, x in rows if g == "a"], [x for _, g, x in rows if g == "b"]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.u == min(u, len(a) * len(b) - u)
    sd = math.sqrt(len(a) * len(b) * (len(a) + len(b) + 1) / 12)
    assert r.p_value == pytest.approx(math.erfc(abs(r.u - len(a) * len(b) / 2) / sd / math.sqrt(2)), abs=1e-6)


def test_bootstrap_interval_covers_mean(spark):
    rng = np.random.default_rng(1)
    x = rng.exponential(size=300)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, id int, x double")
    r = ST.bootstrap_ci(df, ["k"], "x", ["id"], 400).first()
    se = x.std() / math.sqrt(300)
    assert r.estimate == pytest.approx(x.mean())
    for lo, hi in ((r.ci_low, r.ci_high), (r.bca_low, r.bca_high)):
        assert lo < x.mean() < hi and 3 * se < hi - lo < 5 * se


def test_permutation_test_sees_a_difference(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i % 2) + (i * 37 % 11) / 11) for i in range(200)], "id int, g string, x double")
    same = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i * 37 % 11)) for i in range(200)], "id int, g string, x double")
    assert ST.permutation_test(df, "g", "a", "x", "id", 60).first().p_value == 0.0
    assert ST.permutation_test(same, "g", "a", "x", "id", 60).first().p_value > 0.05


def test_draws_look_random_and_repeat(spark):
    df = spark.range(20000).select(uniform("s", "id").alias("u"), normal("s", "id").alias("z"))
    r = df.agg(F.avg("u"), F.var_pop("u"), F.avg("z"), F.var_pop("z")).first()
    assert r[0] == pytest.approx(0.5, abs=0.01) and r[1] == pytest.approx(1 / 12, abs=0.005)
    assert r[2] == pytest.approx(0, abs=0.03) and r[3] == pytest.approx(1, abs=0.04)
    again = spark.range(20000).repartition(7).select(uniform("s", "id").alias("u"))
    assert again.agg(F.sum("u")).first()[0] == pytest.approx(df.agg(F.sum("u")).first()[0])
    x = [-3.0, -1.0, 0.0, 0.5, 2.5]
    got = [v[0] for v in spark.createDataFrame([(v,) for v in x], "x double").select(norm_cdf(F.col("x"))).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], atol=1e-6)


# ---------------------------------------------------------------- raster, flow, logs, quality
def test_convolve_and_blur_against_numpy(spark):
    rng = np.random.default_rng(3)
    img = rng.random((9, 12))
    rows = spark.createDataFrame([(1, y, [float(v) for v in img[y]]) for y in range(9)], "image_id long, y long, v array<double>")
    for name in ("sobel_x", "laplacian", "sharpen"):
        w, scale, offset = L.KERNELS[name]
        k = np.array(w, dtype=float).reshape(3, 3)
        want = np.array([[(img[y - 1:y + 2, x - 1:x + 2] * k).sum() / scale + offset for x in range(1, 11)] for y in range(1, 8)])
        got = {r.y: r.v for r in R.convolve(rows, name).collect()}
        assert sorted(got) == list(range(1, 8)) and np.allclose([got[y] for y in sorted(got)], want)
    b = np.array([1, 4, 6, 4, 1]) / 16
    want = np.array([[(img[y - 2:y + 3, x - 2:x + 3] * np.outer(b, b)).sum() for x in range(2, 10)] for y in range(2, 7)])
    got = {r.y: r.v for r in R.blur(rows, 2).collect()}
    assert np.allclose([got[y] for y in sorted(got)], want)


def test_rotations(spark):
    img = np.arange(12).reshape(3, 4)
    px = spark.createDataFrame([(1, x, y, float(img[y, x])) for y in range(3) for x in range(4)], "image_id long, x int, y int, v double")
    for k in range(4):
        want = np.rot90(img, k)
        got = np.full(want.shape, -1.0)
        for r in R.rotate(px, k).collect():
            got[r.y, r.x] = r.v
        assert (got == want).all()


def test_gather_splits_hot_keys_but_keeps_everything(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") * 2).alias("v"))
    rows = D.gather(df, ["k"], "i", "v", 64).orderBy("chunk").collect()
    assert len(rows) == 16 and [x for r in rows for x in r["values"]] == [2 * i for i in range(1000)]


def test_branches_keep_null_conditions(spark):
    df = spark.createDataFrame([(1, 60.0), (2, None), (3, 5.0)], "id int, v double")
    out = D.branch_if(df, F.col("v") > 50, lambda x: x.withColumn("p", F.lit("hi")), lambda x: x.withColumn("p", F.lit("lo")))
    assert {r.id: r.p for r in out.collect()} == {1: "hi", 2: "lo", 3: "lo"}


def test_log_lines_to_metrics(spark):
    lines = [
        (10, 1, "START RequestId: a-1 Version: 1"), (11, 2, "[METRICS] dynamo_reads=3 dynamo_writes=2"),
        (12, 3, "[DEBUG] DynamoDB GetItem done"), (13, 4, "[DEBUG] Ready: 1/3"), (14, 5, "[ERROR] boom"), (15, 6, "Traceback later"),
        (20, 7, "END RequestId: a-1"), (20, 8, "REPORT RequestId: a-1 Duration: 9.50 ms Billed Duration: 10 ms Memory Size: 256 MB "
                                              "Max Memory Used: 70 MB Init Duration: 100.25 ms"),
        (30, 9, "[METRICS] s3_puts=4 s3_gets=5")]
    df = spark.createDataFrame([(t, s, "f", m) for t, s, m in lines], "ts_ms long, seq long, log_group string, message string")
    r = LG.function_metrics(LG.sessionise_logs(df, 7)).first()
    assert (r.request_id, r.start_ms, r.end_ms, r.billed_ms, r.memory_mb, r.init_ms, r.cold_start) == ("a-1", 10, 20, 10.0, 256, 100.25, True)
    assert (r.table_reads, r.table_writes, r.object_puts, r.object_gets, r.error) == (5, 2, 4, 5, "[ERROR] boom")


def test_payload_contract(spark):
    rows = ['{"a": 1, "b": "x"}', '{"a": "1"}', '{"b": 2}', "not json"]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    got = {r.field: (r.n_ok, r.n_missing, r.n_mismatched) for r in Q.validate_payloads(df, "j", {"a": "integer", "b": "string"}).collect()}
    assert got == {"a": (1, 2, 1), "b": (1, 2, 1)}


def test_lookup_join_broadcasts_only_below_the_limit(spark):
    big = spark.range(1000).withColumn("x", F.col("id"))
    small = spark.range(10).withColumn("y", F.col("id"))

    def plan(limit):
        return join_lookup(big, small, "id", limit=limit)._jdf.queryExecution().logical().toString()

    assert "strategy=broadcast" in plan(10 ** 9).lower() and "strategy=broadcast" not in plan(1).lower()


def test_fan_in_batch_brute_force(spark):
    rng = random.Random(8)
    a = [(i, rng.randint(0, 3), rng.randint(0, 10 ** 11)) for i in range(80)]
    b = [(i, rng.randint(0, 3), rng.randint(0, 10 ** 11)) for i in range(80)]
    got = sorted((r.ai, -1 if r.bi is None else r.bi) for r in W.fan_in_batch(
        spark.createDataFrame(a, "ai long, k long, at long"), spark.createDataFrame(b, "bi long, k long, bt long"), "k", "at", "bt").collect())
    want = []
    for i, k, t in a:
        m = [j for j, kk, u in b if kk == k and t <= u <= t + 3_600_000_000]
        want += [(i, j) for j in m] or [(i, -1)]
    assert got == sorted(want)


def test_quantile_blocks_grow_with_value(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("x"))
    rows = quantile_blocks(df, ["k"], "x", 8).orderBy("x").collect()
    blocks = [r["__block"] for r in rows]
    assert blocks == sorted(blocks) and len(set(blocks)) == 8


def test_unknown_bases_are_no_bases(spark):
    """N and lower case read as an unknown codon, and count as neither GC nor AT."""
    seq = "ATG" + "GCC" * 30 + "NAA" + "gcc" + "GCT" * 5 + "TAA" + "CC"
    df = spark.createDataFrame([(1, seq), (2, "N" * 1000), (3, "é" * 9)], "seq_id long, sequence string")
    got = [(r.seq_id, r.frame, r.start, r.end, r.peptide) for r in S.find_orfs(df, 75).collect()]
    assert (1, 0, 0, len(seq) - 2, "M" + "A" * 30 + "??" + "A" * 5) in got and {g[0] for g in got} == {1}
    assert [r.gc for r in S.segment_stats(df.where("seq_id = 2"), 1000).collect()] == [0.0]


def test_fan_in_batch_with_nulls(spark):
    a = spark.createDataFrame([(1, None, 5, 6), (2, "x", 5, 6), (3, None, 7, 6)], "ai long, note string, k long, at long")
    b = spark.createDataFrame([(9, 5, 6)], "bi long, k long, bt long")
    got = sorted((r.ai, r.note, r.bi) for r in W.fan_in_batch(a, b, "k", "at", "bt").collect())
    assert got == [(1, None, 9), (2, "x", 9), (3, None, None)]


def test_long_path_is_walked_to_its_end(spark):
    df = spark.createDataFrame([(i, i + 1, float(i % 7 + 1)) for i in range(200)], "src long, dst long, weight double")
    assert {r.label for r in G.connected_components(df).collect()} == {0}
    tree = G.mst(df).agg({"weight": "sum", "*": "count"}).collect()[0]
    assert tree["count(1)"] == 200 and tree["sum(weight)"] == sum(i % 7 + 1 for i in range(200))
    short = df.where("src < 61")
    assert {r.node: r.depth for r in G.bfs(short, 0).collect()} == {i: i for i in range(62)}
    assert G.bfs(short, 0, 3).count() == 4
