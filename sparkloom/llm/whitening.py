"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed.  A pass multiplies it with a narrow block of vectors: every task centres its rows,
adds up Xc'(Xc Q) and Spark sums the cells, so driver and tasks hold dimensions x block numbers however many rows
there are.  A Chebyshev polynomial of such passes grows what lies above the block's least Ritz value and damps the
unwanted spectrum below it; QR and a Rayleigh-Ritz step follow, until every wanted pair is certified by its residual
against the gap to its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep

SCALE, SHIFT = 64.0, 1_000_000
#: Scaled entries beyond this have no exact double; such rows count as holding no number.
MOST = float(1 << 52)
#: Angle that the residual of a certified pair allows, and the share of the largest eigenvalue that rounding leaves.
ANGLE, ROUNDING = 1e-9, 3e-14
#: Growth of the largest direction over the damped ones that a filter may reach before the block is made orthogonal.
GROWTH, DEGREES = 1e10, 24


def to_integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dims, x): floor(64 c) + 1000000 of every entry c of the rows that hold numbers only."""

    def convert(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(SCALE * np.asarray(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False), np.float64))
                fine = np.abs(scaled) < MOST
            row = np.repeat(np.arange(len(sizes)), sizes)
            good = (sizes > 0) & (np.bincount(row[~fine], minlength=len(sizes)) == 0)
            at = np.flatnonzero(good)
            offsets = np.concatenate(([0], np.cumsum(sizes[at]))).astype(np.int32)
            x = scaled[good[row]].astype(np.int64) + SHIFT
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(sizes[at].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))],
                                             names=["vec_id", "dims", "x"])

    return embeddings.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(convert, "vec_id long, dims int, x array<long>")


def _sum_cells(rows: DataFrame, dims: int, cells: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``add(x of a batch)``, a vector of ``cells`` doubles."""

    def each(batches):
        total = np.zeros(cells)
        for batch in batches:
            total += add(batch.column(0).flatten().to_numpy().reshape(-1, dims))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "v"])

    found = rows.select("x").mapInArrow(each, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(cells)
    out[found["cell"].to_numpy()] = found["v"].to_numpy()
    return out


@dataclass
class Whitening:
    """Rows that were fitted, their sums, and the certified components with eigenvalues and trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray  # dimensions x components
    values: np.ndarray
    trace: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def _ritz(q: np.ndarray, vq: np.ndarray):
    """Rayleigh-Ritz in the block: falling values, vectors, their images and the norms of the residuals."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, vq = q @ turn, vq @ turn
    return values, q, vq, np.linalg.norm(vq - q * values, axis=0)


def _degree(values: np.ndarray, wanted: int, cut: float, top: float, short: float) -> int:
    """Passes that bring the last wanted pair below its bound, as far as the first does not outgrow the block."""
    far = lambda v: np.arccosh(max(2 * v / cut - 1, 1 + 1e-6))
    return int(max(2, min(np.ceil(np.arccosh(2 * max(short, 1.0)) / far(values[wanted - 1])), np.log(2 * GROWTH) // far(top), DEGREES)))


def _filter(multiply, q: np.ndarray, vq: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of the covariance on ``q``; [0, cut] is damped, ``top`` stays near one."""
    half = cut / 2
    sigma = half / (top - half)
    twice, before, now = 2 / sigma, q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (twice - sigma)
        before, now = now, 2 * following / half * (multiply(now) - half * now) - sigma * following * before
        sigma = following
    return now


def fit(rows: DataFrame, dims: int, components: int = 32, extra: int = 24, seed: int = 11) -> Whitening | None:
    """The leading components of ``rows(x)``, all of ``dims`` entries; None without rows.

    ``extra`` further directions are carried in the block: the more, the wider the part of the spectrum that is
    damped.  Directions without variance are no components.
    """
    def totals(batches):
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, dims)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1, dtype=np.int32)), pa.array(np.append(total, n))], names=["cell", "v"])

    found = rows.select("x").mapInArrow(totals, "cell int, v long").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    sums = np.zeros(dims + 1, np.int64)
    sums[found["cell"].to_numpy()] = found["v"].to_numpy()
    model = Whitening(int(sums[-1]), sums[:-1], np.zeros((dims, 0)), np.zeros(0), 0.0, 1)
    if model.n == 0:
        return None
    n, total, block = model.n, model.sums, min(dims, components + extra)

    def multiply(q: np.ndarray) -> np.ndarray:
        def add(x):
            c = (n * x - total) / n
            return np.append(c.T @ (c @ q), (c * c).sum())

        out = _sum_cells(rows, dims, dims * block + 1, add) / n
        model.trace = float(out[-1])
        model.passes += 1
        return out[:-1].reshape(dims, block)

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, block)))[0]
    best, stalled = np.inf, 0
    while True:
        values, q, vq, residuals = _ritz(q, multiply(q))
        top = values[0]
        wanted = int(np.sum(values[:components] > 1e-12 * dims * max(top, 0)))
        if wanted == 0:
            return model
        steps = np.append(values[:-1] - values[1:], np.inf)
        gaps = np.minimum(steps, np.append(np.inf, steps[:-1]))
        short = float((residuals / np.maximum(ANGLE * gaps, ROUNDING * top))[:wanted].max())
        best, stalled = (short, 0) if short < best / 2 else (best, stalled + 1)
        if short <= 1 or block == dims or (stalled > 8 and (residuals[:wanted] <= 10 * ROUNDING * top).all()):
            model.vectors, model.values = np.ascontiguousarray(q[:, :wanted]), values[:wanted]
            return model
        cut = max(values[-1], 1e-9 * top)
        q = np.linalg.qr(_filter(multiply, q, vq, _degree(values, wanted, cut, top, short), cut, top))[0]


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, in one pass."""
    dims, k = model.vectors.shape

    def add(x):
        w = model.whitened(x)
        return np.concatenate((w.sum(axis=0), (w.T @ w).reshape(-1)))

    sums = _sum_cells(rows, dims, k + k * k, add) / model.n
    mean = sums[:k]
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums over dimensions of (n x - S)^2; null where a long cannot hold one."""
    apart = n * x - sums
    if x.size == 0 or float(np.abs(apart).max()) ** 2 * x.shape[1] < 2.0**62:
        return pa.array((apart * apart).sum(axis=1))
    exact = [sum(v * v for v in row) for row in apart.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = 32, extra: int = 24, seed: int = 11, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """A row (``OUT``) for every vector and component, components numbered from 1 by falling eigenvalue.

    Vectors that are null, empty or hold null or non-finite entries (or entries of 2**46 and more) are left out, and so
    are those of another length than the most frequent one (the shorter on ties): they have no covariance with the
    rest.  Repeated rows count and come back each, null ids too; further columns are ignored.  Fewer dimensions, or
    directions without variance, give fewer components; equal vectors only, or no vector, give no row.
    """
    spark = embeddings.sparkSession
    good = keep(to_integers(embeddings, id_col, vector_col), "whitening-vectors")
    length = good.groupBy("dims").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "dims").first()
    if length is None:
        return spark.createDataFrame([], OUT)
    dims, rows = length.dims, good.where(F.col("dims") == length.dims)
    model = fit(rows, dims, components, extra, seed)
    if model is None or not len(model.values):
        return spark.createDataFrame([], OUT)
    error, k = identity_error(rows, model), len(model.values)
    explained = model.values / model.trace

    def project(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dims)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n)),
                 _deviations(x, model.n, model.sums).take(each), pa.array(model.whitened(x).reshape(-1)), pa.array(np.tile(explained, len(x))),
                 pa.array(np.full(len(x) * k, error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(project, OUT)
