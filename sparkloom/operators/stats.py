"""Descriptive statistics, rank tests, effect sizes and resampling over result tables.

Groups may be huge, so exact order statistics come from value counts with two-level running sums
(``plans.ordered``) rather than from an aggregate that holds a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.storagelevel import StorageLevel

from ..functions.draws import Digests, poisson1
from ..functions.draws import replicates as draw_replicates
from ..functions.numeric import norm_cdf
from ..plans.iterate import cut
from ..plans.joins import attach
from ..plans.ordered import running_sums
from ..plans.tables import spread
from .bootstrap import bootstrap_interval, intervals


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    return df.select(*keys, F.inline(rows)).where(F.col("x").isNotNull())


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values with their count and the inclusive running count, per key.

    Equal values collapse map-side first; the running count is a prefix scan over the rest.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("cnt"), *[c.alias(n) for n, c in (extra or {}).items()])
    return running_sums(counts, keys, [F.col(value)], {"cum": F.col("cnt")})


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation: columns ``q0, q1, …`` per key."""
    cum = cumulative_counts(df, keys, value)
    cum = cum.join(cum.groupBy(*keys).agg(F.max("cum").alias("n")), list(keys))
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        for name, rank in ((f"lo{i}", F.floor(pos)), (f"hi{i}", F.ceil(pos))):
            here = (rank >= F.col("cum") - F.col("cnt")) & (rank < F.col("cum"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(name))
    out = cum.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        out = out.withColumn(f"q{i}", F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (pos - F.floor(pos)))
    return out.select(*keys, *[f"q{i}" for i in range(len(probs))])


QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def describe_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """n, mean, median, std, IQR, min, max, percentiles and CV % per key and metric."""
    long = unpivot(df, keys, metrics)
    k = [*keys, "metric"]
    basic = long.groupBy(*k).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
                                 F.min("x").alias("min"), F.max("x").alias("max"))
    q = percentiles(long, k, "x", list(QUANTILES.values()))
    for i, name in enumerate(QUANTILES):
        q = q.withColumnRenamed(f"q{i}", name)
    out = basic.join(q, k)
    return out.withColumn("iqr", F.col("p75") - F.col("p25")).withColumn(
        "cv_pct", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.col("mean") * 100))


def vs_baseline(described: DataFrame, baseline: str, workflow: str = "workflow", config: str = "config") -> DataFrame:
    """Improvement of medians over the baseline configuration, in percent."""
    base = F.max(F.when(F.col(config) == baseline, F.col("median"))).over(Window.partitionBy(workflow, "metric"))  # a row for each configuration
    return described.withColumn("base_median", base).where((F.col(config) != baseline) & F.col("base_median").isNotNull()).withColumn(
        "improvement_pct", F.when(F.col("base_median") == 0, 0.0).otherwise(
            (F.col("base_median") - F.col("median")) / F.col("base_median") * 100))


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, first: str, value: str) -> DataFrame:
    """Mann-Whitney U of one group against the rest, average ranks for ties, normal approximation."""
    mine = F.col(group) == first
    cum = cumulative_counts(df, keys, value, {"a": F.count_if(mine)})
    rank = F.col("cum") - F.col("cnt") + (F.col("cnt") + 1) / 2.0
    out = cum.groupBy(*keys).agg(F.sum(F.col("a") * rank).alias("r1"), F.sum("a").alias("nx"),
                                 F.sum(F.col("cnt") - F.col("a")).alias("ny"))
    nx, ny = F.col("nx").cast("double"), F.col("ny").cast("double")
    u1 = F.col("r1") - nx * (nx + 1) / 2
    out = out.withColumn("u", F.least(u1, nx * ny - u1))
    sigma = F.sqrt(nx * ny * (nx + ny + 1) / 12)
    z = (F.col("u") - nx * ny / 2) / sigma
    p = F.when((nx < 3) | (ny < 3), F.lit(None)).when(sigma == 0, 1.0).otherwise(2 * norm_cdf(-F.abs(z)))
    return out.select(*keys, "nx", "ny", "u", p.alias("p_value"))


def cohens_d(df: DataFrame, keys: Sequence[str], group: str, first: str, value: str) -> DataFrame:
    """Effect size with pooled standard deviation and its label."""
    mine = F.col(group) == first
    x, y = F.when(mine, F.col(value)), F.when(~mine, F.col(value))
    out = df.groupBy(*keys).agg(
        F.count(x).alias("nx"), F.count(y).alias("ny"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"))
    pooled = F.sqrt(((F.col("nx") - 1) * F.col("vx") + (F.col("ny") - 1) * F.col("vy")) / (F.col("nx") + F.col("ny") - 2))
    d = F.when(pooled == 0, 0.0).otherwise((F.col("mx") - F.col("my")) / pooled)
    size = F.abs(F.col("d"))
    return out.withColumn("d", d).select(
        *keys, "nx", "ny", "d", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium")
        .otherwise("large").alias("label"))


def bootstrap_means(df: DataFrame, keys: Sequence[str], value: str, row_id: Sequence[str], replicates: int,
                    seed: str = "42") -> DataFrame:
    """Mean of every bootstrap replicate.

    Each row draws a Poisson(1) weight per replicate from its own id (the large-sample form of
    drawing with replacement): no row numbers, no join, and sums are combined map-side.
    """
    base = df.select(*keys, *[c for c in row_id if c not in keys], F.col(value).alias("__x"))
    sums = draw_replicates(base, replicates, seed, *row_id).withColumn("w", poisson1(F.col("u"))).groupBy(*keys, "rep").agg(
        F.sum(F.col("w") * F.col("__x")).alias("s"), F.sum("w").alias("w"))
    return sums.where(F.col("w") > 0).select(*keys, "rep", (F.col("s") / F.col("w")).alias("stat"))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, row_id: Sequence[str], replicates: int = 200,
                 confidence: float = 0.95, seed: str = "42") -> DataFrame:
    """Percentile and BCa bootstrap intervals of the mean.

    The jackknife of a mean needs no leave-one-out pass: its acceleration is the skewness of the
    values divided by ``6 sqrt(n)``.  Only the replicate means (a bounded array) are held per key.
    """
    boots = bootstrap_means(df, keys, value, row_id, replicates, seed)
    obs = df.groupBy(*keys).agg(F.avg(value).alias("estimate"), F.count("*").alias("n"), F.skewness(value).alias("skew"))
    acc = F.coalesce(F.nanvl("skew", F.lit(0.0)), F.lit(0.0)) / (6 * F.sqrt("n"))
    return intervals(boots, obs.select(*keys, "n", "estimate", acc.alias("acc")), keys, confidence)


def _digest_ranks(df: DataFrame, lows: float, highs: float, permutations: int, seed: str) -> DataFrame:
    """(rep, u, id, x, c, s): every row whose digest lies in (lows, highs], and number and sum of a task's rows up to ``lows``."""
    def run(batches):
        count, total, seen = np.zeros(permutations, np.int64), np.zeros(permutations), 0
        for batch in batches:
            seen += len(batch)
            ids, x = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            draws = Digests(batch.column(2).to_pylist())
            for rep in range(1, permutations + 1):
                u = draws.uniforms(f"{seed}:{rep}")[0]
                low = u <= lows
                count[rep - 1] += low.sum()
                total[rep - 1] += x[low].sum()
                at = np.flatnonzero(~low & (u <= highs))
                if len(at):
                    yield pa.record_batch({"rep": pa.array(np.full(len(at), rep, np.int32)), "u": pa.array(u[at]), "id": ids.take(pa.array(at)),
                                           "x": pa.array(x[at]), "c": pa.nulls(len(at), pa.int64()), "s": pa.nulls(len(at), pa.float64())})
        if not seen:
            return
        none = [pa.nulls(permutations, t) for t in (pa.float64(), kind, pa.float64())]
        yield pa.record_batch(dict(zip(("rep", "u", "id", "x", "c", "s"), (
            pa.array(np.arange(1, permutations + 1, dtype=np.int32)), *none, pa.array(count), pa.array(total)))))

    kind = to_arrow_type(df.schema["id"].dataType)
    tail = F.coalesce(F.concat(F.lit(":"), F.col("id").cast("string")), F.lit(""))
    rows = spread(df).select("id", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), tail.alias("tail"))
    return rows.mapInArrow(run, f"rep int, u double, id {df.schema['id'].dataType.simpleString()}, x double, c long, s double")


def permutation_test(df: DataFrame, group: str, first: str, value: str, row_id: str, permutations: int = 100,
                     seed: str = "perm", per_bucket: int = 1000) -> DataFrame:
    """Two-sided permutation test of a difference of means.

    Each permutation keeps the group size exactly: its group is the ``n_a`` rows with the smallest digests.  Where the
    cut lies is known to a few standard deviations (and ``per_bucket`` rows), so one pass draws all digests of a row
    with numpy, adds up what is surely below, and only rows near the cut (8 sqrt(n) of a permutation) are ranked.
    Should a cut lie outside, the pass is made again with wider limits.
    """
    sizes = cut(df.agg(F.count_if(F.col(group) == first).alias("na"), F.count("*").alias("n"), F.sum(value).alias("total"),
                       F.avg(F.when(F.col(group) == first, F.col(value))).alias("ma"),
                       F.avg(F.when(F.col(group) != first, F.col(value))).alias("mb")))
    n, na = sizes.select("n", "na").first()
    share = na / max(n, 1)
    margin = (8 * math.sqrt(n * share * (1 - share)) + per_bucket) / max(n, 1)
    rows = df.select(F.col(row_id).alias("id"), F.col(value).alias("x"))
    while True:
        lows, highs = (share - margin if share > margin else 0.0), (share + margin if share + margin < 1 else 1.0)
        held = _digest_ranks(rows, lows, highs, permutations, seed).persist(StorageLevel.MEMORY_AND_DISK)  # drawn once, stored twice
        drawn = cut(held)
        held.unpersist()
        low = drawn.groupBy("rep").agg(F.sum("c").alias("below"), F.sum("s").alias("s"), F.count("u").alias("near"))
        rest = F.lit(na) - F.col("below")
        if (lows == 0 and highs == 1) or low.where((rest < 0) | (rest > F.col("near"))).isEmpty():
            break
        margin *= 8
    ranked = drawn.where(F.col("u").isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy("u", "id")))
    inside = ranked.join(F.broadcast(low.select("rep", "below")), "rep").where(F.col("k") <= rest).groupBy("rep").agg(F.sum("x").alias("t"))
    stat = attach(low.join(inside, "rep", "left").select("rep", (F.col("s") + F.coalesce("t", F.lit(0.0))).alias("sa")), sizes)
    rest = F.nullif(F.col("n") - F.col("na"), F.lit(0))
    diff = F.abs(F.col("sa") / F.nullif(F.col("na"), F.lit(0)) - (F.col("total") - F.col("sa")) / rest)
    observed = F.abs(F.col("ma") - F.col("mb"))
    return stat.agg(F.max(observed).alias("observed"), F.avg(diff).alias("perm_mean"),
                    F.avg(F.when(diff >= observed, 1.0).otherwise(0.0)).alias("p_value"), F.count("*").alias("permutations"))


def describe_with_intervals(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], replicates: int = 10_000) -> DataFrame:
    """``describe_metrics`` with the bootstrap interval of the median (ci_lower, ci_upper; BCa)."""
    k = [*keys, "metric"]
    ci = bootstrap_interval(unpivot(df, keys, metrics), k, "x", "median", replicates)
    return describe_metrics(df, keys, metrics).join(ci.select(*k, F.col("bca_low").alias("ci_lower"), F.col("bca_high").alias("ci_upper")), k)


def compare(df: DataFrame, keys: Sequence[str], group: str, first: str, value: str, level: float = 0.05) -> DataFrame:
    """Rank test with its flag of significance and effect size of one group against the rest."""
    ranks = mann_whitney(df, keys, group, first, value)
    size = cohens_d(df, keys, group, first, value).select(*keys, F.col("d").alias("cohens_d"), F.col("label").alias("effect_size"))
    return ranks.join(size, list(keys)).withColumn("significant", F.coalesce(F.col("p_value") < level, F.lit(False)))


def main_results(described: DataFrame, latency: str, cost: str, billed: str, workflow: str = "workflow", config: str = "config") -> DataFrame:
    """A row for each workflow and configuration: median, IQR, p95 and interval of the latency, mean cost, billed median."""
    of = lambda metric, column, name: F.max(F.when(F.col("metric") == metric, F.col(column))).alias(name)
    return described.groupBy(workflow, config).agg(
        of(latency, "median", "e2e_median"), of(latency, "iqr", "e2e_iqr"), of(latency, "p95", "e2e_p95"), of(latency, "ci_lower", "e2e_ci_lower"),
        of(latency, "ci_upper", "e2e_ci_upper"), of(cost, "mean", "cost_mean"), of(billed, "median", "billed_median"))


def summary_table(described: DataFrame, configs: Sequence[str], workflow: str = "workflow", config: str = "config") -> DataFrame:
    """Median, IQR and p95 per workflow with one column group per configuration."""
    return described.groupBy(workflow, "metric").pivot(config, list(configs)).agg(
        F.first("median").alias("median"), F.first("iqr").alias("iqr"), F.first("p95").alias("p95"))


def mode_summary(df: DataFrame, mode: str, latency: str, memory: str) -> DataFrame:
    """Averages, tail latencies and memory use per execution mode."""
    base = df.groupBy(mode).agg(F.count("*").alias("n"), F.avg(latency).alias("avg_latency"), F.avg(memory).alias("avg_memory"))
    q = percentiles(df, [mode], latency, [0.5, 0.95, 0.99])
    return base.join(q, mode).select(
        mode, "n", "avg_latency", "avg_memory", F.col("q0").alias("p50"), F.col("q1").alias("p95"), F.col("q2").alias("p99"),
        (F.col("avg_latency") / F.col("avg_memory")).alias("latency_per_memory"))
