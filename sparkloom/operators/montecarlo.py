"""Monte Carlo estimates from deterministic draws, evaluated inside the rows they belong to."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import normal, uniform_pair


def mc_pi(points: DataFrame, index: str, checkpoints: list[int], seed: str = "pi") -> DataFrame:
    """Estimates of pi after the first 100, 1000, … points, by one conditional aggregation."""
    u, v = uniform_pair(seed, index)
    inside = F.when(u * u + v * v <= 1.0, 1.0).otherwise(0.0)
    p = points.select(F.col(index).alias("i"), inside.alias("hit"))
    aggs = []
    for c in checkpoints:
        aggs += [F.sum(F.when(F.col("i") < c, F.col("hit"))).alias(f"h{c}"), F.count_if(F.col("i") < c).alias(f"n{c}")]
    wide = p.agg(*aggs, F.sum("hit").alias("h"), F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.col(f"n{c}").alias("samples"), F.col(f"h{c}").alias("inside")) for c in checkpoints],
                   F.struct(F.col("n").alias("samples"), F.col("h").alias("inside")))
    out = wide.select(F.inline(rows)).distinct().withColumn("estimate", 4.0 * F.col("inside") / F.col("samples"))
    return out.select("samples", "estimate", F.abs(F.col("estimate") - math.pi).alias("error"))


def gbm_paths(params: DataFrame, key: str, steps: int = 100, seed: str = "walk") -> DataFrame:
    """Geometric random walks per ``(start, drift, vol)`` row: final, extremes, mean, spread, return.

    A path is folded inside its row with a running state, so nothing is exploded or shuffled.
    """
    dt = 1.0 / steps
    drift = (F.col("drift") - 0.5 * F.col("vol") * F.col("vol")) * dt
    zs = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: normal(seed, F.col(key), i))
    start = F.col("start").cast("double")
    zero = F.struct(start.alias("pos"), start.alias("hi"), start.alias("lo"), start.alias("sum"), (start * start).alias("sq"))

    def move(s, z):
        pos = s["pos"] * F.exp(drift + F.col("vol") * math.sqrt(dt) * z)
        return F.struct(pos.alias("pos"), F.greatest(s["hi"], pos).alias("hi"), F.least(s["lo"], pos).alias("lo"),
                        (s["sum"] + pos).alias("sum"), (s["sq"] + pos * pos).alias("sq"))

    out = params.withColumn("s", F.aggregate(zs, zero, move))
    mean = F.col("s.sum") / (steps + 1)
    var = F.greatest(F.col("s.sq") / (steps + 1) - mean * mean, F.lit(0.0))
    return out.select(key, "start", F.col("s.pos").alias("final"), F.col("s.hi").alias("max"), F.col("s.lo").alias("min"),
                      mean.alias("mean"), F.sqrt(var).alias("std"),
                      ((F.col("s.pos") - F.col("start")) / F.abs(F.col("start") + 1e-15) * 100).alias("return_pct"))


def mc_option_price(contracts: DataFrame, key: str, n: int = 1000, seed: str = "option") -> DataFrame:
    """European call per contract row: price, standard error, 95 % interval, delta by a 1 % bump.

    Needs ``spot, strike, rate, vol, expiry``; base and bumped price share their draws.
    """
    drift = (F.col("rate") - 0.5 * F.col("vol") * F.col("vol")) * F.col("expiry")
    spread = F.col("vol") * F.sqrt("expiry")
    growth = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.exp(drift + spread * normal(seed, F.col(key), i)))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("u"))

    def pay(spot: Column) -> Column:
        return F.greatest(spot - F.col("strike"), F.lit(0.0))

    def add(a, g):
        p = pay(F.col("spot") * g)
        return F.struct((a["s"] + p).alias("s"), (a["q"] + p * p).alias("q"), (a["u"] + pay(F.col("spot") * 1.01 * g)).alias("u"))

    out = contracts.withColumn("a", F.aggregate(growth, zero, add)).withColumn("disc", F.exp(-F.col("rate") * F.col("expiry")))
    mean = F.col("a.s") / n
    var = F.greatest((F.col("a.q") - n * mean * mean) / (n - 1), F.lit(0.0))
    out = out.select(key, "spot", (F.col("disc") * mean).alias("price"), (F.col("disc") * F.sqrt(var / n)).alias("std_error"),
                     (F.col("disc") * F.col("a.u") / n).alias("price_up"))
    return out.select(key, "price", "std_error", (F.col("price") - 1.96 * F.col("std_error")).alias("ci_low"),
                      (F.col("price") + 1.96 * F.col("std_error")).alias("ci_high"),
                      ((F.col("price_up") - F.col("price")) / (F.col("spot") * 0.01)).alias("delta"))
