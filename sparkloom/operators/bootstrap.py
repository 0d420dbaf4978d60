"""Exact bootstrap of means and medians in blocks, without a row for each draw.

A replicate draws as many values as a group has, with replacement.  How many of them fall into each block of the
ordered values is drawn by a binary tree of binomials over the block numbers: every node has a generator of its own
(seed, group, node), so a block walks down from the root by itself and knows its share and how many draws lie before it,
in every replicate at once.  A block then adds up its draws (mean), or draws only the order statistic that the median
asks for where that lies in it (its place among ``m`` uniform draws is a beta variable).  What leaves a block is a row
for each replicate at most; the draws themselves never become rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import norm_cdf, norm_ppf
from ..plans.iterate import cut
from ..plans.joins import join_lookup
from ..plans.ordered import row_numbers

BLOCK_ROWS = 8192
#: Draws that a block holds at once while it adds them up.
HELD = 1 << 21


def ordered_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, x, rn, n): values in their order from 0, with the size of the group; nulls are left out."""
    numbered = row_numbers(df.select(*keys, F.col(value).cast("double").alias("x")).where("x IS NOT NULL"), keys, [F.col("x")])
    numbered = numbered.withColumn("rn", F.col("rn") - 1)
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return join_lookup(numbered, sizes, list(keys), "inner") if keys else numbered.crossJoin(F.broadcast(sizes))


def block_shares(seed: int, group: int, n: int, block: int, rows: int, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """(draws in earlier blocks, draws in this block) of every replicate of ``n`` draws; blocks hold ``rows`` values."""
    low, high = 0, -(-n // rows)
    here, before = np.full(replicates, n, np.int64), np.zeros(replicates, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * rows / (min(high * rows, n) - low * rows)
        left = np.random.default_rng([seed, group, low, high]).binomial(here, share)
        if block < middle:
            here, high = left, middle
        else:
            before, here, low = before + left, here - left, middle
    return before, here


def block_sums(x: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sum of ``draws[r]`` values drawn from ``x`` for every replicate r."""
    out = np.zeros(len(draws))
    ends = np.cumsum(draws)
    lo = 0
    while lo < len(draws):
        base = ends[lo] - draws[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + HELD, side="right")))
        taken = np.append(0.0, np.cumsum(x[rng.integers(0, len(x), ends[hi - 1] - base)]))
        at = np.concatenate(([0], ends[lo:hi] - base))
        out[lo:hi] = taken[at[1:]] - taken[at[:-1]]
        lo = hi
    return out


def block_medians(x: np.ndarray, before: np.ndarray, here: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(replicate, value) of the middle order statistics of ``n`` draws that lie in this block; two of them if n is even."""
    first, second = (n - 1) // 2, n // 2
    low, more = rng.beta(np.maximum(first - before, 0) + 1.0, np.maximum(here - np.maximum(first - before, 0), 1.0)), rng.random(len(here))
    in_first = (before <= first) & (first < before + here)
    place = lambda u: np.minimum((u * len(x)).astype(np.int64), len(x) - 1)
    reps, values = [np.flatnonzero(in_first)], [x[place(low[in_first])]]
    if second > first:
        in_second = (before <= second) & (second < before + here)
        after = np.maximum(here - np.maximum(second - before, 0), 1.0)
        start = np.where(in_first, low, 0.0)  # without the first here, the second is the least of all draws here
        high = 1 - (1 - start) * more ** (1 / after)
        reps.append(np.flatnonzero(in_second))
        values.append(x[place(high[in_second])])
    return np.concatenate(reps), np.concatenate(values)


def replicate_statistics(values: DataFrame, keys: Sequence[str], statistic: str = "median", replicates: int = 10_000,
                         seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, rep, stat) from ``ordered_values``: the mean or the median of every replicate."""
    if statistic not in ("mean", "median"):
        raise ValueError("statistic must be mean or median")
    group = F.xxhash64(*keys).bitwiseAND(F.lit((1 << 62) - 1)) if keys else F.lit(0).cast("long")
    blocks = values.withColumn("block", F.floor(F.col("rn") / block_rows)).withColumn("__g", group)

    def draw(key, table):
        table = table.sort_by("rn")
        x, n, g, block = table["x"].to_numpy(), table["n"][0].as_py(), table["__g"][0].as_py(), table["block"][0].as_py()
        before, here = block_shares(seed, g, n, block, block_rows, replicates)
        rng = np.random.default_rng([seed, g, block, n, block_rows])
        reps, found = (np.arange(replicates), block_sums(x, here, rng)) if statistic == "mean" else block_medians(x, before, here, n, rng)
        out = table.select(list(keys)).take(pa.array(np.zeros(len(reps), np.int64))) if keys else pa.table({})
        for name, column in (("rep", pa.array(reps.astype(np.int32))), ("v", pa.array(found)), ("n", pa.array(np.full(len(reps), n)))):
            out = out.append_column(name, column)
        return out

    schema = T.StructType([*[values.schema[k] for k in keys], T.StructField("rep", T.IntegerType()), T.StructField("v", T.DoubleType()), T.StructField("n", T.LongType())])
    parts = blocks.groupBy(*keys, "block").applyInArrow(draw, schema).groupBy(*keys, "rep")
    stat = F.sum("v") / F.max("n") if statistic == "mean" else F.avg("v")
    return parts.agg(stat.alias("stat"))


def estimates(values: DataFrame, keys: Sequence[str], statistic: str) -> DataFrame:
    """(keys, n, estimate, acc): the statistic and the acceleration of its jackknife.

    Leaving one value out moves a mean by its distance, and a median to one of three values by the side of the
    value left out, so counts stand for the leave-one-out pass.
    """
    if statistic == "mean":
        out = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("estimate"), F.skewness("x").alias("skew"))
        acc = F.coalesce(F.nanvl("skew", F.lit(0.0)), F.lit(0.0)) / (6 * F.sqrt("n"))
        return out.select(*keys, "n", "estimate", acc.alias("acc"))
    half = F.floor(F.col("n") / 2)
    at = lambda step: F.max(F.when(F.col("rn") == half + step, F.col("x")))
    out = values.groupBy(*keys).agg(F.max("n").alias("n"), at(-1).alias("a"), at(0).alias("b"), at(1).alias("c"))
    odd, h = F.col("n") % 2 == 1, F.floor(F.col("n") / 2).cast("double")
    sides = F.when(odd, F.array(F.struct(h.alias("w"), ((F.col("b") + F.col("c")) / 2).alias("m")), F.struct(h.alias("w"), ((F.col("a") + F.col("b")) / 2).alias("m")),
                                F.struct(F.lit(1.0).alias("w"), ((F.col("a") + F.col("c")) / 2).alias("m")))).otherwise(
        F.array(F.struct(h.alias("w"), F.col("b").alias("m")), F.struct(h.alias("w"), F.col("a").alias("m"))))
    total = lambda f: F.aggregate("sides", F.lit(0.0), lambda acc, s: acc + s["w"] * f(s["m"]))
    out = out.withColumn("sides", sides).withColumn("mean", total(lambda m: m) / F.col("n"))
    apart = lambda p: total(lambda m: F.pow(F.col("mean") - m, F.lit(float(p))))
    out = out.withColumn("s2", apart(2)).withColumn("s3", apart(3))
    estimate = F.when(odd, F.col("b")).otherwise((F.col("a") + F.col("b")) / 2)
    return out.select(*keys, "n", estimate.alias("estimate"),
                      F.when(F.col("s2") > 0, F.col("s3") / (6 * F.pow("s2", F.lit(1.5)))).otherwise(0.0).alias("acc"))


def interpolate(sorted_array: Column, p: Column) -> Column:
    """Percentile ``p`` of a sorted array with linear interpolation."""
    pos = p * (F.size(sorted_array) - 1)
    lo = F.element_at(sorted_array, (F.floor(pos) + 1).cast("int"))
    hi = F.element_at(sorted_array, (F.ceil(pos) + 1).cast("int"))
    return lo + (hi - lo) * (pos - F.floor(pos))


def intervals(stats: DataFrame, observed: DataFrame, keys: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """(keys, n, estimate, ci_low, ci_high, bca_low, bca_high) from replicates (rep, stat) and estimates (n, estimate, acc).

    Only the replicates of a group, whose number is a parameter, are held together.
    """
    joined = stats.join(observed, list(keys)) if keys else stats.crossJoin(F.broadcast(observed))
    rows = joined.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "estimate", "acc")], F.array_sort(F.collect_list("stat")).alias("b"),
        F.avg(F.when(F.col("stat") < F.col("estimate"), 1.0).otherwise(0.0)).alias("below"))
    alpha = 1 - confidence
    rows = rows.withColumn("z0", norm_ppf(F.col("below")))

    def adjusted(q):
        z = F.col("z0") + norm_ppf(F.lit(q))
        return norm_cdf(F.col("z0") + z / (1 - F.col("acc") * z))

    return rows.select(
        *keys, "n", "estimate",
        interpolate(F.col("b"), F.lit(alpha / 2)).alias("ci_low"), interpolate(F.col("b"), F.lit(1 - alpha / 2)).alias("ci_high"),
        interpolate(F.col("b"), adjusted(alpha / 2)).alias("bca_low"), interpolate(F.col("b"), adjusted(1 - alpha / 2)).alias("bca_high"))


def bootstrap_interval(df: DataFrame, keys: Sequence[str], value: str, statistic: str = "median", replicates: int = 10_000,
                       confidence: float = 0.95, seed: int = 42, block_rows: int = BLOCK_ROWS, least: int = 5) -> DataFrame:
    """Percentile and BCa bootstrap intervals of the median or the mean of every group.

    Groups of fewer than ``least`` values have their estimate for both ends; nulls are left out, and groups of
    nothing else have no row.
    """
    values = cut(ordered_values(df, keys, value))
    observed = estimates(values, keys, statistic)
    out = intervals(replicate_statistics(values, keys, statistic, replicates, seed, block_rows), observed, keys, confidence)
    few = F.col("n") < least
    return out.withColumns({c: F.when(few, F.col("estimate")).otherwise(F.col(c)) for c in ("ci_low", "ci_high", "bca_low", "bca_high")})
