"""Graph algorithms on edge tables: degrees, PageRank, BFS, components, minimum spanning tree.

Each round is a join and an aggregation over an edge table; lineage is cut with a reliable checkpoint so that a
lost executor does not replay all rounds.  Neighbour contributions are summed before the shuffle (partial
aggregation), so a hub's incoming messages meet as partial sums; its outgoing edges are split into parts.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..plans.iterate import cut, known_partitions, release
from ..plans.joins import attach, join_spread


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge (self-loops once); edges are read once and doubled in the row."""
    there = F.struct("src", "dst", "weight")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))))


def degrees(edges: DataFrame) -> DataFrame:
    both = undirected(edges)
    return both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def adjacency(edges: DataFrame, chunk: int = 1000) -> DataFrame:
    """Neighbour lists in bounded stretches: a hub has several rows, not one huge array."""
    both = undirected(edges)
    sized = degrees(edges).select(F.col("node").alias("src"), F.ceil(F.col("degree") / chunk).alias("parts"))
    part = F.pmod(F.hash("dst"), F.col("parts")).cast("long").alias("part")
    return both.join(sized, "src").select("src", part, "dst").groupBy("src", "part").agg(
        F.array_sort(F.collect_list("dst")).alias("neighbours"))


def rank_links(edges: DataFrame, hub_degree: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(src, dst, deg) in both directions: links of ordinary sources, by source, and those of hubs, by target.

    A vertex cut: a source with more than ``hub_degree`` links is a hub, whose links lie all over the cluster.  Links of
    ordinary sources are counted where they lie by source, so they are sent once.
    """
    both = undirected(edges).select("src", "dst")
    hubs = F.broadcast(cut(both.groupBy("src").agg(F.count("*").alias("deg")).where(F.col("deg") > hub_degree)))
    links = both.join(hubs, "src", "left_anti").repartition("src")
    counted = links.groupBy("src").agg(F.count("*").alias("deg"))
    return links.join(counted.hint("merge"), "src").select("src", "dst", "deg"), both.join(hubs, "src").repartition("dst")


def pagerank(edges: DataFrame, damping: float = 0.85, iters: int = 100, tol: float | None = 1e-6,
             every: int = 5, hub_degree: int = 100_000) -> DataFrame:
    """PageRank on an undirected graph; stops at ``iters`` rounds or when the L1 change is below ``tol``.

    The change is checked every ``every`` rounds.  The links are cached once and reused by all rounds: ordinary ones
    meet their source's value by source; the values of hubs, of which there are at most links / hub_degree, are
    broadcast to where their links lie.  Links and values stay dealt by node, so a round sends only the sums for the targets.
    With ``tol``, all rounds come out of a few of them (``_all_rounds``).
    """
    with known_partitions(edges.sparkSession):
        return _ranks(edges, damping, iters, tol, every, hub_degree)


def _ranks(edges: DataFrame, damping: float, iters: int, tol: float | None, every: int, hub_degree: int) -> DataFrame:
    pairs = edges.select("src", "dst", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    links, hub_links = (part.persist(StorageLevel.MEMORY_AND_DISK) for part in rank_links(pairs, hub_degree))
    links.count()
    hubs = cut(hub_links.select(F.col("src").alias("node"), "deg").distinct())
    any_hub = not hubs.isEmpty()
    pairs.unpersist()
    nodes = links.select(F.col("src").alias("node"), "deg").distinct()
    nodes = nodes.unionByName(hubs) if any_hub else nodes

    def neighbours(values: DataFrame, value) -> DataFrame:
        """(node, got): sum of ``value`` over the neighbours; every node of an undirected edge has one."""
        sent = links.join(values, links.src == values.node).select("dst", value(links).alias("sent"))
        if any_hub:
            few = F.broadcast(values.join(F.broadcast(hubs.select("node")), "node", "left_semi"))
            sent = sent.unionByName(hub_links.join(few, hub_links.src == few.node).select("dst", value(hub_links).alias("sent")))
        return sent.groupBy(F.col("dst").alias("node")).agg(F.sum("sent").alias("got"))

    if tol is not None:
        ranks = _all_rounds(nodes, neighbours, damping, iters, tol, every)
    else:
        n = nodes.count()
        base = (1.0 - damping) / n if n else 0.0
        ranks = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
        for i in range(iters):
            ranks = neighbours(ranks, lambda part: F.col("rank") / part["deg"]).select("node", (F.lit(base) + F.lit(damping) * F.col("got")).alias("rank"))
            if i % every == every - 1 or i == iters - 1:
                ranks = cut(ranks)
        ranks = ranks.withColumn("iterations", F.lit(iters))
    links.unpersist()
    hub_links.unpersist()
    return ranks


def _all_rounds(nodes: DataFrame, neighbours, damping: float, iters: int, tol: float, every: int, many: int = 20_000_000) -> DataFrame:
    """Ranks after the first checked round whose change is below ``tol``, from a Lanczos basis of the walk.

    Walking is symmetric once scaled by the degrees, so a few orthogonal directions q1, q2, ... (one join and one
    aggregation each) span the ranks of every round, and their coefficients follow from a small tridiagonal matrix: 80
    rounds need about 15 directions.  What lies outside the directions is bounded by the last coefficient; they go on
    until that bound is a ten-thousandth of ``tol`` in L1, or there are as many as rounds, when nothing is left out.

    A direction is sent in whole steps of a grid that is so fine that the ranks of no round change by more than a few
    millionths of ``tol``: later directions, whose coefficients are small, take few digits.  Only directions are stored; with
    more than ``many`` links, the files of a round are given up when it is over.
    """
    one = nodes.agg(F.count("*").alias("n"), F.sum("deg").alias("links"), F.sum(1.0 / F.col("deg")).alias("inverse"), F.max("deg").alias("most")).first()
    if not one["n"]:
        return nodes.select("node", F.lit(0.0).alias("rank"), F.lit(0).alias("iterations"))
    scale = math.sqrt(one["inverse"]) / one["n"]
    nodes = cut(nodes.select("node", "deg"))
    basis, diagonal, beside = [cut(nodes.select("node", (1.0 / (F.col("deg") * one["n"] * scale)).alias("q0")))], [], []
    reach = math.sqrt(one["links"]) * scale * damping / (1 - damping)
    weight = 1.0
    while True:
        # a vector of norm 1 has no value above 1, and no more than the root of the degree over the neighbours of a node
        exact = max(tol * 2e-6, 1e-16) / reach / (weight / (1 - damping))
        grid = 2 * exact / math.sqrt(one["links"])
        fits = math.sqrt(one["most"]) / grid < 2 ** 62
        j = len(diagonal)
        sent = basis[j].select("node", (F.round(F.col(f"q{j}") / grid).cast("long") if fits else F.col(f"q{j}")).alias("q"))
        state = nodes.join(basis[j], "node").join(basis[j - 1], "node") if j else nodes.join(basis[j], "node").withColumn("p", F.lit(0.0))
        moved = state.join(neighbours(sent, lambda _: F.col("q")), "node").select(
            "node", "deg", F.col(f"q{j}").alias("q"), F.col(f"q{j - 1}" if j else "p").alias("p"),
            (F.col("got") * F.lit(grid if fits else 1.0) / F.col("deg")).alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
        product = lambda x, y: F.sum(F.col("deg") * F.col(x) * F.col(y)).alias(x + y)
        got = moved.agg(*[product(*pair) for pair in itertools.combinations_with_replacement("wqp", 2)]).first()
        a, b = got["wq"], beside[-1] if beside else 0.0
        diagonal.append(a)
        rest = F.col("w") - a * F.col("q") - b * F.col("p")
        square = got["ww"] - 2 * a * got["wq"] - 2 * b * got["wp"] + a * a * got["qq"] + 2 * a * b * got["qp"] + b * b * got["pp"]
        if square < 1e-4 * got["ww"]:  # digits were lost
            square = moved.agg(F.sum(F.col("deg") * rest * rest)).first()[0]
        norm = math.sqrt(square)
        walk = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
        rounds = [np.eye(len(diagonal))[0]]
        for _ in range(iters):
            rounds.append((1 - damping) * rounds[0] + damping * walk @ rounds[-1])
        weight = norm * max(abs(y[-1]) for y in rounds)
        if reach * weight <= max(tol * 1e-4, 1e-14) or len(basis) > iters:
            moved.unpersist()
            break
        beside.append(norm)
        basis.append(moved.select("node", (rest / norm).alias(f"q{len(basis)}")).checkpoint())
        moved.unpersist()
        if one["links"] > many:
            del state, sent, moved
            release(nodes.sparkSession)
    spanned = functools.reduce(lambda x, y: x.join(y, "node"), basis).join(nodes, "node").persist(StorageLevel.MEMORY_AND_DISK)
    mixed = lambda y: F.col("deg") * sum((F.col(f"q{j}") * float(c * scale) for j, c in enumerate(y)), F.lit(0.0))
    checked = [*range(every, iters, every), iters]
    changes = spanned.agg(*[F.sum(F.abs(mixed(rounds[k] - rounds[k - 1]))).alias(str(k)) for k in checked]).first()
    used = next((k for k in checked if changes[str(k)] < tol), iters)
    ranks = cut(spanned.select("node", mixed(rounds[used]).alias("rank")))
    spanned.unpersist()
    return ranks.withColumn("iterations", F.lit(used))


def bfs(edges: DataFrame, source, max_depth: int | None = None) -> DataFrame:
    """Distance of every reachable node: frontier join, anti join against the visited set.

    Goes on until no node is left to reach; ``max_depth`` asks for the nodes up to a distance only.
    """
    both = undirected(edges).select("src", "dst").persist(StorageLevel.MEMORY_AND_DISK)
    frontier = both.sparkSession.range(1).select(F.lit(source).alias("node"), F.lit(0).alias("depth"))
    visited = frontier
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = both.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % 10 == 0:
            visited = cut(visited)
    both.unpersist()
    return visited


def bfs_summary(levels: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """Visited nodes, depth, mean distance, reachable ratio (``n_nodes`` is one row)."""
    s = levels.agg(F.count("*").alias("visited"), F.max("depth").alias("max_depth"), F.avg("depth").alias("average_distance"))
    return attach(s, n_nodes).withColumn("reachable_ratio", F.col("visited") / F.col("n_nodes"))


def _followed(parent: DataFrame) -> DataFrame:
    """(node, root) by following (node, up) to the end of every chain, four times as far each time."""
    while True:
        for _ in range(2):
            ups = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            parent = parent.join(ups, "up").select("node", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved"))
        moved = cut(parent)
        parent = moved.select("node", "up")
        if moved.where("moved").isEmpty():
            return parent.withColumnRenamed("up", "root")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node id of each node's component, by hooking and contraction.

    Each round every node points to its smallest neighbour, chains are followed to their roots, edges are rewritten
    to roots, and those inside one component leave, so a component that is found, however large, is in no
    further join.  Labels with very many nodes are spread over several tasks.
    """
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    live, labels = cut(pairs.distinct()), None
    while True:
        both = live.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))))
        parent = cut(both.groupBy("node").agg(F.min("near").alias("up")).select("node", F.least("node", "up").alias("up")))
        roots = _followed(parent)
        named = roots.select(F.col("node").alias("label"), "root")
        labels = roots.select("node", F.col("root").alias("label")) if labels is None else cut(
            join_spread(labels, named, "label", "node", "left").select("node", F.coalesce("root", "label").alias("label")))
        by_a, by_b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = cut(live.join(by_a, "a").join(by_b, "b").where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if live.isEmpty():
            return labels


def threshold_clusters(pairs: DataFrame, a: str, b: str, distance: str, cut_at: float) -> DataFrame:
    """Single-linkage clusters cut at a distance = components of the pairs within it."""
    near = pairs.where(F.col(distance) <= cut_at).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(1.0).alias("weight"))
    return connected_components(near)


def propagated_components(edges: DataFrame) -> DataFrame:
    """Smallest node id of each node's component, by label propagation with pointer jumping, until nothing changes."""
    both = undirected(edges).select("src", "dst").persist(StorageLevel.MEMORY_AND_DISK)
    labels = cut(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.src, "left").select(
            "node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        # follow the label's own label: halves the distance to the smallest id every round
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = cut(hooked.join(jump, "low", "left").select(
            "node", "label", F.least("low", F.coalesce("lower", "low")).alias("new")))
        changed = new.where(F.col("new") != F.col("label")).limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            break
    both.unpersist()
    return labels


def mst(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest by Boruvka rounds; ties broken by (weight, src, dst).

    Every round each component picks its lightest outgoing edge (an aggregate with map-side
    combining); merged components are found by following the picked edges, each time four times as far.  Of the
    edges between the same two components only the lightest goes on, so late rounds are small.
    """
    norm = edges.where(F.col("src") != F.col("dst")).groupBy(F.least("src", "dst").alias("ca"), F.greatest("src", "dst").alias("cb")).agg(F.min("weight").alias("weight"))
    live = cut(norm.select("ca", "cb", F.struct("weight", F.col("ca").alias("src"), F.col("cb").alias("dst")).alias("key")))
    chosen = live.select("key.src", "key.dst", "key.weight").limit(0)
    while True:
        ends = live.select(F.inline(F.array(F.struct(F.col("ca").alias("node"), "key", F.col("cb").alias("up")), F.struct(F.col("cb").alias("node"), "key", F.col("ca").alias("up")))))
        best = cut(ends.groupBy("node").agg(F.min(F.struct("key", "up")).alias("b")).select("node", "b.up", "b.key.src", "b.key.dst", "b.key.weight"))
        if best.isEmpty():
            return chosen.distinct()
        chosen = chosen.unionByName(best.select("src", "dst", "weight"))
        # every component points along its own edge; the two that picked the same one are the only circle, cut at the smaller
        back = best.select(F.col("node").alias("up"), F.col("up").alias("back"))
        parent = best.select("node", "up").join(back, "up").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up"))
        roots = _followed(cut(parent))
        by_a, by_b = roots.select(F.col("node").alias("ca"), F.col("root").alias("ra")), roots.select(F.col("node").alias("cb"), F.col("root").alias("rb"))
        live = cut(live.join(by_a, "ca").join(by_b, "cb").where("ra <> rb").groupBy(
            F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")).agg(F.min("key").alias("key")))


def mst_summary(tree: DataFrame, n_nodes: DataFrame) -> DataFrame:
    s = tree.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("total_weight"), F.min("weight").alias("min_weight"),
                 F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight"))
    return attach(s, n_nodes).withColumn("is_connected", F.col("n_edges") == F.col("n_nodes") - 1)


def graph_summary(pr_top: DataFrame, bfs_row: DataFrame, mst_row: DataFrame) -> DataFrame:
    """One row with text insights; all inputs are single rows or a top list."""
    top = pr_top.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "node"))),
                                                        lambda s: s["node"].cast("string")), ", ").alias("top"))
    j = attach(attach(top, bfs_row.select("max_depth", "reachable_ratio")), mst_row.select("total_weight", "is_connected"))
    return j.select(
        F.concat(F.lit("Most influential nodes: "), "top").alias("influence"),
        F.concat(F.lit("Graph diameter (from source): "), F.col("max_depth").cast("string")).alias("diameter"),
        F.when(F.col("reachable_ratio") < 1, F.concat(F.lit("Warning: Only "), F.format_string("%.1f", F.col("reachable_ratio") * 100),
                                                      F.lit("% of nodes reachable from source")))
        .otherwise("Graph is fully connected from source node").alias("reach"),
        F.concat(F.lit("MST total weight: "), F.format_string("%.2f", "total_weight")).alias("tree"),
        F.when(~F.col("is_connected"), "Warning: Graph is not fully connected").otherwise("").alias("warning"))
