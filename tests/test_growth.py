"""Work that belongs to one sequence or document stays in its row: nothing grown from it is joined, sorted or shuffled."""

import hashlib
import itertools
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from sparkloom.functions import draws
from sparkloom.functions.draws import Digests
from sparkloom.llm import _text, quality
from sparkloom.operators import graph, phrases
from sparkloom.operators import sequence as Q
from sparkloom.plans import grouped
from sparkloom.plans.iterate import cut as plain
from sparkloom.plans.iterate import known_partitions
from sparkloom.plans.joins import estimated_bytes
from sparkloom.sources import events
from sparkloom.streaming.flows import assemble_fields

QUERIES = entry_module.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["SQ-28", "SQ-21", "SQ-41", "SQ-02-6", "SQ-23", "SQ-24", "SQ-11-sequences"])
def test_kmers_stay_in_their_row(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert p.count("Exchange hashpartitioning") == 1 and "Join" not in p and "Window" not in p and "BroadcastExchange" not in p


def test_kmer_pairs_brute_force_and_repeated_keys(spark):
    r = random.Random(4)
    texts = [(1, "".join(r.choices("ACGT", k=300))), (2, "".join(r.choices("ACGT", weights=(9, 1, 1, 9), k=900))), (1, "".join(r.choices("AC", k=80)))]
    df = spark.createDataFrame(texts, "seq_id long, sequence string")
    got = {(x.seq_id, x.kind): [] for x in Q.kmer_pairs(Q.kmer_gc_profiles(df, 4)).collect()}
    for x in Q.kmer_pairs(Q.kmer_gc_profiles(df, 4)).collect():
        got[x.seq_id, x.kind].append((x.kmer_a, x.kmer_b, x.distance, x.n_pairs))
    for key in (1, 2):
        n = {}
        for k, t in texts:
            for i in range(len(t) - 3 if k == key else 0):
                n[t[i:i + 4]] = n.get(t[i:i + 4], 0) + 1
        e = max(sum(n.values()) / 256, 1)
        at = {m: (sum(c in "GC" for c in m) / 4, c / e) for m, c in n.items()}
        near = [(round(((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5, 9), a, b) for a, b in itertools.combinations(sorted(n), 2)]
        for kind, hits in (("similar", [x for x in near if x[0] < 0.1]), ("dissimilar", [(-x[0], *x[1:]) for x in near if x[0] > 1.5])):
            want = [(a, b, pytest.approx(abs(d)), len(hits)) for d, a, b in sorted(hits)[:50]]
            assert got.get((key, kind), []) == want


@pytest.mark.parametrize("name", ["NL-05-3", "NL-05-4", "NL-09", "NA-11", "NA-12", "NA-13-hubs", "NA-13-stats", "NA-18", "NC-07", "NC-07-primary",
                                  "NC-08", "NC-08-topics", "NS-05", "NS-06"])
def test_phrases_stay_in_their_row(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "Generate explode(regexp" not in p and "Generate explode(transform" not in p and "array_join(slice" not in p
    if name not in ("NC-07-primary", "NC-08-topics", "NS-05", "NS-06"):  # these go on with a few rows for each document
        assert p.count("Exchange hashpartitioning") == 1 and "Join" not in p and "Window" not in p


@pytest.mark.parametrize("n,k", [(2, 100), (3, 80), (4, 50), (4, None)])
def test_ngrams_brute_force(n, k):
    r = random.Random(n)
    many = [f"w{i}" for i in range(60_000)]  # four of them do not fit a long
    r.shuffle(many)
    for texts in (["b a b a", "", "a b ab a b ab a b c d'e d'e 0 9"], ["a"], [""], [" ".join(r.choices(["a", "ab", "abc", "b0", "b'c"], k=700))],
                  [" ".join(many + many[:300]), " ".join(many[:300])]):
        counts = {}
        for w in map(str.split, texts):
            for i in range(len(w) - n + 1):
                g = " ".join(w[i:i + n])
                counts[g] = counts.get(g, 0) + 1
        assert phrases._grams(phrases._numbered(texts), n, k) == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_one_long_word_does_not_widen_all_rows():
    rows = [[f"{i} {j}" for j in range(180)] for i in range(255)] + [["x" * 20_000, "y"]]
    tracemalloc.start()
    got = grouped._joined(rows, "string")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [x for some in rows for x in some] and peak < 20 << 20


@pytest.mark.parametrize("name", ["NC-10", "NS-08", "SQ-31-bootstrap", "SQ-47"])
def test_replicates_are_drawn_in_their_row(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "md5(concat_ws(:, 42" not in p and "explode(sequence" not in p and "explode([" not in p


@pytest.mark.parametrize("head", ["42:7", "", "cons:-12", "x" * 52, "long" * 30])
def test_digests_are_md5(head):
    tails = [f":{i}:{j}" for i in range(70) for j in (1, 22, 333)]
    got = Digests(tails).words(head, 200)
    for i, t in enumerate(tails[:200]):
        want = hashlib.md5((head + t).encode()).hexdigest()
        assert "".join(f"{int(w[i]):08x}" for w in got) == want


def test_many_heads_are_digested_together(monkeypatch):
    """Short stretches of draws share the calls of one digest, and Poisson counts come from a table, exactly as from the bounds."""
    r = random.Random(1)
    heads = ["chi2:" + "".join(r.choices("0123456789:", k=r.choice([3, 9, 10, 60]))) for _ in range(300)]
    sizes = [r.randrange(1, 210) for _ in heads]
    d = Digests([f":{i}:{b}" for i in range(30) for b in range(7)])
    want = [np.concatenate(x) for x in zip(*[d.words(h, n) for h, n in zip(heads, sizes)])]
    calls, md5 = [], draws._md5
    monkeypatch.setattr(draws, "_md5", lambda m, n: (calls.append(n), md5(m, n))[1])
    for got, w in zip(d.words_of(heads, sizes), want):
        assert (got == w).all()
    assert len(calls) < 10
    at = (draws.poisson_bounds() * draws.TWO32).astype(np.int64)
    edges = np.concatenate([at + i for i in range(-3, 4)] + [[0, 1, 2**32 - 1]]).clip(0, 2**32 - 1).astype(np.uint32)
    words = np.concatenate([edges, np.random.default_rng(1).integers(0, 2**32, 200_000, dtype=np.uint32)])
    assert (draws.PoissonCounts()(words) == np.searchsorted(draws.poisson_bounds(), (words + 1.0) / draws.TWO32)).all()


def test_shares_of_nothing_draw_nothing(spark, monkeypatch):
    """Every draw of a share of zero misses, so none is made; other shares count as by the uniform numbers."""
    rows = [(i, i * 3 % 17, i % 5, s) for i, s in enumerate([0.0, 0.25, 1.0, 0.1 + 0.2, 1 / 3, 2.0**-33, 0.0])]
    df = spark.createDataFrame(rows, "seq_id long, n_conserved long, n_variable long, score double")
    got = {x.seq_id: x for x in Q.binomial_ci(df, 60).collect()}
    for i, a, b, s in rows:
        n = max(a + b, 1)
        u = [[(int(hashlib.md5(f"cons:{i}:{k}:{j}".encode()).hexdigest()[:8], 16) + 1) / 2**32 for j in range(1, n + 1)] for k in range(1, 61)]
        v = sorted(sum(x < s for x in row) / n for row in u)
        assert (got[i].lower, got[i].upper) == (v[1], v[58]) and got[i].mean == pytest.approx(sum(v) / 60)
    monkeypatch.setattr(draws.Digests, "words", lambda self, head, n=None: pytest.fail("drawn"))
    monkeypatch.setattr(Q, "map_lists", lambda df, keys, lists, fn, schema, with_key: fn("7", np.array([40.0, 0.0])))
    assert Q.binomial_ci(df, 60) == {"mean": [0.0], "lower": [0.0], "upper": [0.0], "std": [0.0]}


def test_draws_are_dealt_over_all_tasks(spark):
    """Scores that were counted by sequence are few bytes; their draws still run in as many tasks as there are partitions."""
    counted = spark.range(4000).groupBy((F.col("id") % 400).alias("seq_id")).agg(
        F.lit(1).alias("n_conserved"), F.count("*").alias("n_variable"), F.lit(0.3).alias("score"))
    out = Q.binomial_ci(counted, 20).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() >= 8 and out.count() == 400


def test_classifier_blocks_are_small():
    texts = pa.array([" ".join(f"word{i * j % 997}" for i in range(600)) for j in range(1500)])
    model = quality.Model(np.arange(1, 600, dtype=np.uint64), np.ones((599, 2)), np.zeros(2), np.full(2, 0.1))
    tracemalloc.start()
    for _, _, raw, offsets in _text.blocks(texts, quality.BLOCK):
        model.evidence(raw, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def test_text_objects_share_files(spark, tmp_path):
    texts = [(i, f" a\r\n{i}\n\n") for i in range(300)] + [(300, ""), (301, None), (None, "x")]
    path = str(tmp_path / "texts")
    events.write_texts(spark.createDataFrame(texts, "k long, t string"), path, "k", "t")
    got = {r.pointer: r.loaded for r in events.read_texts(spark, path).collect()}
    assert got == {str(k): t for k, t in texts if k is not None and t is not None}
    assert len(list((tmp_path / "texts").rglob("part-*"))) < 50


@pytest.mark.parametrize("hub_degree", [3, 100_000])
def test_pagerank_rounds_come_from_few_of_them(spark, hub_degree, monkeypatch):
    r = random.Random(3)
    pairs = {(r.randrange(60) * 2, r.randrange(400) * 2 + 1) for _ in range(900)} | {(9000, 9001)}
    calls = []
    monkeypatch.setattr(graph, "cut", lambda df: (calls.append(1), plain(df))[1])
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")
    got = {x.node: (x["rank"], x.iterations) for x in graph.pagerank(df, 0.85, 100, 1e-6, hub_degree=hub_degree).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    old, rounds = {v: 1 / len(near) for v in near}, 0
    while True:
        new = {v: 0.15 / len(near) + 0.85 * sum(old[u] / len(near[u]) for u in near[v]) for v in near}
        change, old, rounds = sum(abs(new[v] - old[v]) for v in near), new, rounds + 1
        if rounds % 5 == 0 and change < 1e-6 or rounds == 100:
            break
    assert {v: k for v, (_, k) in got.items()} == {v: rounds for v in near} and rounds > 50
    assert sum(abs(got[v][0] - old[v]) for v in near) < 1e-9
    assert len(calls) < rounds // 2


def test_ranks_are_the_same_when_files_of_rounds_are_given_up(spark, monkeypatch):
    r, calls = random.Random(4), []
    df = spark.createDataFrame([(r.randrange(40) * 2, r.randrange(90) * 2 + 1, 1.0) for _ in range(300)], "src long, dst long, weight double")
    want = {x.node: x["rank"] for x in graph.pagerank(df, 0.85, 20, 1e-3).collect()}
    rounds, given_up = graph._all_rounds, graph.release
    monkeypatch.setattr(graph, "release", lambda session: (calls.append(1), given_up(session)))
    monkeypatch.setattr(graph, "_all_rounds", lambda *a: rounds(*a, many=1))
    got = {x.node: x["rank"] for x in graph.pagerank(df, 0.85, 20, 1e-3).collect()}
    assert got.keys() == want.keys() and max(abs(got[v] - want[v]) for v in want) < 1e-12 and len(calls) > 3


def test_rounds_keep_their_partitions(spark):
    """A table stored by node is joined by node where it lies, so a round of ranks sends only the sums for the targets."""
    with known_partitions(spark):
        rows = spark.range(5000).select(F.col("id").alias("node"), (F.col("id") * 2).alias("q"))
        kept = plain(rows.repartition("node"))
        again = plain(kept.join(kept.select("node", F.col("q").alias("p")).hint("merge"), "node"))
        assert "Exchange" not in plan(kept.join(again.select("node", "p").hint("merge"), "node"))
        sums = again.groupBy((F.col("node") % 7).alias("node")).agg(F.sum("p").alias("got"))
        assert plan(again.join(sums.hint("merge"), "node")).count("Exchange") == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_spanning_forest_merges_without_label_rounds(spark, monkeypatch):
    """Components that picked edges in a long chain are merged by following them, in a logarithm of its length."""
    calls = []
    monkeypatch.setattr(graph, "cut", lambda df: (calls.append(1), plain(df))[1])
    rows = [(i, i + 1, float(500 - i)) for i in range(200)] + [(i + 1, i, float(500 - i)) for i in range(200)] + [(900, 901, 1.0), (5, 5, 0.0), (900, 901, 3.0)]
    tree = graph.mst(spark.createDataFrame(rows, "src long, dst long, weight double")).collect()
    assert sorted((x.src, x.dst, x.weight) for x in tree) == sorted([(i, i + 1, float(500 - i)) for i in range(200)] + [(900, 901, 1.0)])
    assert len(calls) < 20


def test_stored_rounds_have_their_measured_size(spark):
    """The size of a join is estimated as the product of its sides; over stored rounds that must not become a product of them all."""
    chain = plain(spark.range(1000).select(F.col("id").alias("node"), F.greatest(F.col("id") - 1, F.lit(0)).alias("up")))
    for _ in range(7):
        ups = chain.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        chain = plain(chain.join(ups, "up").select("node", F.col("upper").alias("up")))
    assert estimated_bytes(chain) < 1 << 20
    assert chain.count() == 1000 and chain.where("node < 129").agg(F.max("up")).first()[0] == 0


def test_spanning_forest_keeps_the_lightest_edge_between_components(spark, monkeypatch):
    """Late rounds hold one edge for two components, not all edges between them; the forest is that of Kruskal, ties included."""
    stored = []
    monkeypatch.setattr(graph, "cut", lambda df: (out := plain(df), stored.append(out))[0])
    r = random.Random(8)
    rows = [(r.randrange(120), r.randrange(120), float(r.randrange(1, 40))) for _ in range(3000)] + [(500, 501, 2.0), (501, 502, 2.0), (500, 502, 2.0)]
    tree = {(x.src, x.dst, x.weight) for x in graph.mst(spark.createDataFrame(rows, "src long, dst long, weight double")).collect()}
    lightest, home, want = {}, {}, set()
    for a, b, w in rows:
        if a != b:
            key = (min(a, b), max(a, b))
            lightest[key] = min(w, lightest.get(key, w))

    def root(v):
        while home.get(v, v) != v:
            v = home[v]
        return v

    for (a, b), w in sorted(lightest.items(), key=lambda x: (x[1], x[0])):
        if root(a) != root(b):
            home[root(a)] = root(b)
            want.add((a, b, w))
    assert tree == want
    live = [df for df in stored if "ca" in df.columns]
    assert len(live) > 2 and all(df.count() == df.select("ca", "cb").distinct().count() for df in live)


@pytest.mark.parametrize("timeout_s", [300, None])
def test_sessions_share_calls_and_state(spark, tmp_path, timeout_s):
    """Sessions are assembled a group at a time, and each as if it were alone: over several batches, late rows and timeouts."""
    r, names, t0, limit = random.Random(5), ["a", "b", "c"], 1_700_000_000_000_000, (timeout_s or 0) * 1000
    batches = [[(r.choice([None, *range(120)]), r.choice([*names, "other"]), r.choice([None, *"pqrs"]),
                 t0 + (i * 400 + r.randrange(500)) * 1_000_000 + r.randrange(3) * 7001) for _ in range(150)] for i in range(4)]
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "k long, f string, v string, us long")
        frame.select("k", "f", "v", F.timestamp_micros("us").alias("at")).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
        files = list((tmp_path / f"in/b={i}").glob("*.parquet"))
        os.utime(files[0], (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("k long, f string, v string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*/*.parquet"))
    if timeout_s:
        found = assemble_fields(stream.withWatermark("at", "100 seconds"), "k", "f", "v", names, "at", timeout_s, "-", groups=4)
    else:
        found = assemble_fields(stream, "k", "f", "v", names, groups=4)
    run = (found.writeStream.format("memory").queryName(f"sessions_{timeout_s}").trigger(availableNow=True)
           .option("checkpointLocation", str(tmp_path / "state")).start())
    run.awaitTermination()
    assert max(s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]) <= 5

    state, want, mark, seen = {}, [], 0, 0
    for rows in [*batches, []]:
        groups = {}
        for k, f, v, us in rows:
            if not timeout_s or us > mark * 1000:
                groups.setdefault(k, []).append((us if timeout_s else 0, v, f))
        for k, some in groups.items():
            got, until = state.get(k, ({}, 0))
            before = len(got) == 3
            got = {f: v for _, v, f in sorted((x for x in some if x[1] is not None and x[2] in names), reverse=True)} | got
            state[k] = got, max(until, max(x[0] for x in some) // 1000 + limit, mark + limit)
            if len(got) == 3 and not before:
                want.append((k, *[got[n] for n in names], 3, False))
        for k in [k for k, (_, until) in state.items() if timeout_s and until < mark]:
            got, _ = state.pop(k)
            if len(got) < 3:
                want.append((k, *[got.get(n, "-") for n in names], len(got), True))
        seen = max([seen, *[x[3] for x in rows]])
        mark = max(mark, seen // 1000 - 100_000)
    assert sorted(map(str, map(tuple, spark.table(f"sessions_{timeout_s}").collect()))) == sorted(map(str, want))
    assert {x[-1] for x in want} == ({True, False} if timeout_s else {False})
