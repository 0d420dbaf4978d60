"""Approximate nearest neighbours by cosine: hierarchical k-means tree with best-bin-first search.

The tree is fitted on at most ``sample_rows`` distinct vectors; every vector is then placed in a leaf.  A query
walks the tree with a priority queue of branches, nearest centroid first, and visits leaves in that order.  How
many leaves a search visits is calibrated: the true neighbours of ``calibration_queries`` sampled vectors are
found over all rows, and the number of visits is widened until the wanted share of them lies in visited leaves.

Equal vectors are one class, of which only the ``k + 1`` smallest ids can ever be answers, so copies cost
nothing.  Small leaves that lie side by side in the tree share a bin, which a query is sent to once however many of its leaves
it visits (the others of the bin are searched along with them), and large ones are cut into blocks; so rows are sent in bins
of bounded size, and so are the queries that visit them.  A bin hands on at most ``k + 1`` rows for a query, and only such as
are no farther than the query's ``k + 1`` nearest sample rows in the visited leaves.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import keep

LEAF_BLOCK, QUERY_BLOCK = 4096, 1024
#: Rows of one batch of queries on their way to bins.
ROUTES = 4096


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; very large or small rows are scaled first."""
    def scaled(x):
        top = np.abs(x).max(axis=1, keepdims=True)
        return np.where((top > 1e100) | (top < 1e-100), x / top, x)

    a, b = scaled(a), scaled(b)
    norm = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    return np.einsum("ij,ij->i", a, b) / norm


class Tree:
    """Centroids, first child and number of children of every node; a node without children is a leaf."""

    def __init__(self, unit: np.ndarray, leaf_rows: int, branch: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.centroids, self.children, self.leaf_of = [np.zeros(unit.shape[1])], [()], {}
        todo = [(0, unit)]
        while todo:
            node, rows = todo.pop()
            parts = self._split(rows, branch) if len(rows) > leaf_rows else []
            if len(parts) < 2:
                self.leaf_of[node] = len(self.leaf_of)
                continue
            self.children[node] = tuple(range(len(self.centroids), len(self.centroids) + len(parts)))
            for centre, part in parts:
                self.centroids.append(centre)
                self.children.append(())
                todo.append((len(self.centroids) - 1, part))
        self.centroids, self.rng = np.array(self.centroids), None

    def _split(self, rows: np.ndarray, branch: int, rounds: int = 12):
        centres = np.unique(rows[self.rng.permutation(len(rows))[:branch]], axis=0)
        for _ in range(rounds):
            near = np.argmax(rows @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rows)
            size = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
        near = np.argmax(rows @ centres.T, axis=1)
        return [(centres[c], rows[near == c]) for c in np.unique(near)]

    def place(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of every row: the nearest child at every level."""
        out, todo = np.zeros(len(unit), np.int32), [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_of[node]
                continue
            near = np.argmax(unit[rows] @ self.centroids[list(kids)].T, axis=1)
            todo += [(kids[c], rows[near == c]) for c in np.unique(near)]
        return out

    def best_bins(self, query: np.ndarray):
        """Leaves, nearest branch first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.leaf_of[node]
                continue
            for kid, near in zip(kids, (self.centroids[list(kids)] @ query).tolist()):
                heapq.heappush(queue, (-near, kid))


def valid(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _best_blockwise(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, k: int):
    """(query row, member row, score) of the k nearest members of each query, ties to the smaller id."""
    rough = _unit(queries) @ _unit(members).T
    k = min(k, len(members))
    least = np.partition(rough, len(members) - k, axis=1)[:, len(members) - k]
    q, m = np.nonzero(rough >= least[:, None] - 1e-12)
    score = np.concatenate([cosine(queries[q[i:i + 65536]], members[m[i:i + 65536]]) for i in range(0, len(q), 65536)])
    order = np.lexsort((ids[m], -score, q))
    q, m, score = q[order], m[order], score[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    stay = np.arange(len(q)) - first[q] < k
    return q[stay], m[stay], score[stay]


def bins(sizes: dict[int, int], most: int = LEAF_BLOCK) -> dict[int, int]:
    """Bin of every leaf: neighbouring leaves share one up to ``most`` rows; a larger leaf is alone."""
    out, number, held = {}, -1, most
    for leaf in sorted(sizes):
        if held + sizes[leaf] > most:
            number, held = number + 1, 0
        out[leaf], held = number, held + sizes[leaf]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           recall: float = 0.95, sample_rows: int = 16_384, calibration_queries: int = 128, leaf_rows: int = 500,
           branch: int = 8, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every query row, its own id left out.

    Takes no part: null ids, and vectors that are null, zero, not finite, or of another length than the most
    frequent one (the smaller on ties).  Repeated rows count once; an id with several vectors is as near as its
    nearest.  With fewer than ``k`` candidates all are returned.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0].dim
    rows = rows.where(F.size("v") == dim).withColumn("h", F.xxhash64("v"))
    few = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = few.groupBy("h", "v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("c"), "v", "ids")
    classes = keep(classes, "ann-classes")
    total = classes.count()

    sample = classes.select("c", "v").orderBy(F.xxhash64("c", F.lit(seed)), "c").limit(sample_rows).toArrow()
    unit = _unit(_matrix(sample["v"], dim))
    tree = Tree(unit, max(16, leaf_rows * len(unit) // total), branch, seed)
    shared, near_sample = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast((unit, tree.place(unit)))

    def place(batches):
        for b in batches:
            leaf = shared.value.place(_unit(_matrix(b.column(1), dim))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["c", "v", "ids", "leaf"])

    placed = keep(classes.mapInArrow(place, "c long, v array<double>, ids array<long>, leaf int"), "ann-leaves")
    members = {r.leaf: (r.n, r.ids) for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}
    visits = _calibrate(placed, shared, _matrix(sample["v"], dim)[:calibration_queries], sample["c"].to_numpy()[:calibration_queries], k, recall, dim)

    asked = rows.where("asks").select("id", "h", "v")
    heads = asked.groupBy("h", "v").agg(F.min("id").alias("q"))
    who = asked.join(heads, ["h", "v"]).select(F.col("id").alias("query_id"), "q").distinct()

    bin_of = bins({leaf: n for leaf, (n, _) in members.items()})
    home = np.full(len(tree.leaf_of), -1)
    home[list(bin_of)] = list(bin_of.values())
    shared_home = spark.sparkContext.broadcast(home)

    def routes(names, rows, at: list, where: list, floors: list):
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([names.take(at), rows.take(at), pa.array(where, pa.int32()), pa.array(floors, pa.float64())], names=["q", "v", "bin", "floor"])

    def route(batches):
        for b in batches:
            at, where, floors = [], [], []
            for row, query in enumerate(_unit(_matrix(b.column(1), dim)) if b.num_rows else []):
                leaves, seen = [], 0
                for leaf in shared.value.best_bins(query):
                    n, ids = members.get(leaf, (0, 0))
                    if n:
                        leaves.append(leaf)
                        seen += ids
                    if len(leaves) >= visits and seen > k:
                        break
                known, placed_at = near_sample.value
                floor = _floor(known[np.isin(placed_at, leaves)] @ query, k + 1)
                for bin_ in np.unique(shared_home.value[leaves]).tolist():
                    at.append(row)
                    where.append(bin_)
                    floors.append(floor)
                    if len(at) >= ROUTES:
                        yield routes(b.column(0), b.column(1), at, where, floors)
                        at, where, floors = [], [], []
            yield routes(b.column(0), b.column(1), at, where, floors)

    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = keep(heads.select("q", "v").repartition(slots, "q").mapInArrow(route, "q long, v array<double>, bin int, floor double"), "ann-routes")
    asking = {r.bin: r["count"] for r in routed.groupBy("bin").count().collect()}
    rows_of: dict[int, int] = {}
    for leaf, number in bin_of.items():
        rows_of[number] = rows_of.get(number, 0) + members[leaf][0]
    plan = spark.createDataFrame([(number, -(-n // LEAF_BLOCK), -(-asking[number] // QUERY_BLOCK)) for number, n in rows_of.items() if number in asking],
                                 "bin int, blocks int, parts int")
    leaf_plan = spark.createDataFrame(list(bin_of.items()), "leaf int, bin int").join(plan, "bin")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(F.broadcast(leaf_plan), "leaf").withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int")).withColumn("part", every("parts"))
    right = routed.join(F.broadcast(plan), "bin").withColumn("part", F.pmod(F.xxhash64("q"), "parts").cast("int")).withColumn("block", every("blocks"))

    def compare(found, queries):
        if not found.num_rows or not queries.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        ids = found["c"].to_numpy()
        q, m, score = _best_blockwise(_matrix(queries["v"], dim), _matrix(found["v"], dim), ids, k + 1)
        stay = score >= queries["floor"].to_numpy()[q]
        q, m, score = q[stay], m[stay], score[stay]
        return pa.table({"q": queries["q"].to_numpy()[q], "c": ids[m], "ids": found["ids"].combine_chunks().take(pa.array(m)), "score": score})

    place_key = ["bin", "block", "part"]
    near = left.select(*place_key, "c", "v", "ids").groupBy(*place_key).cogroup(right.select(*place_key, "q", "v", "floor").groupBy(*place_key)).applyInArrow(
        compare, "q long, c long, ids array<long>, score double")
    best = _top(near, ["q"], [F.desc("score"), F.asc("c")], k + 1)
    pairs = best.select("q", "score", F.explode("ids").alias("vec_id")).join(who, "q").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _top(pairs, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def _floor(scores: np.ndarray, k: int) -> float:
    """The k-th best score of sample rows in the visited leaves: so good are the k nearest found at least."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) - 1e-9 if len(scores) >= k else -2.0


def _calibrate(placed: DataFrame, shared, queries: np.ndarray, own: np.ndarray, k: int, recall: float, dim: int) -> int:
    """Least number of leaf visits that reach the wanted recall on the calibration queries.

    The true neighbours come from all rows, read in blocks against the fixed set of queries; each task hands on
    ``k`` rows for each query.
    """

    def nearest(batches):
        best: list[tuple] = []
        for b in batches:
            for lo in range(0, b.num_rows, LEAF_BLOCK):
                part = b.slice(lo, LEAF_BLOCK)
                ids, leaf = part.column(0).to_numpy(), part.column(2).to_numpy()
                q, m, score = _best_blockwise(queries, _matrix(part.column(1), dim), ids, k + 1)
                stay = own[q] != ids[m]
                best += zip(q[stay].tolist(), ids[m[stay]].tolist(), leaf[m[stay]].tolist(), score[stay].tolist())
            best.sort(key=lambda x: (x[0], -x[3], x[1]))
            kept, at = [], {}
            for x in best:
                at[x[0]] = at.get(x[0], 0) + 1
                if at[x[0]] <= k:
                    kept.append(x)
            best = kept
        columns = list(zip(*best)) if best else [[]] * 4
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["q", "c", "leaf", "score"])

    near = placed.select("c", "v", "leaf").mapInArrow(nearest, "q int, c long, leaf int, score double")
    truth = _top(near, ["q"], [F.desc("score"), F.asc("c")], k).select("q", "leaf").collect()
    if not truth:
        return 1
    order = {q: {leaf: i for i, leaf in enumerate(shared.value.best_bins(unit))} for q, unit in enumerate(_unit(queries))}
    steps = np.array([order[r.q][r.leaf] for r in truth])
    visits = 1
    while np.mean(steps < visits) < recall:
        visits += max(1, visits // 8)
    return visits
