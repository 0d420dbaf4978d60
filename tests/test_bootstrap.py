"""The bootstrap in blocks against plain resampling, and the prefix scan it stands on."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from sparkloom.operators import bootstrap as B
from sparkloom.plans import ordered as O

RNG = np.random.default_rng(7)


@pytest.mark.parametrize("n, rows", [(1, 4), (8, 8), (37, 5), (1000, 64)])
def test_blocks_share_all_draws(n, rows):
    """The blocks' draws add up to n in every replicate, and each knows how many lie before it."""
    shares = [B.block_shares(3, 99, n, b, rows, 500) for b in range(-(-n // rows))]
    total = np.zeros(500, np.int64)
    for before, here in shares:
        assert (before == total).all() and (here >= 0).all()
        total += here
    assert (total == n).all()
    means = [here.mean() / n for _, here in shares]
    wanted = [min(rows, n - b * rows) / n for b in range(len(shares))]
    assert np.abs(np.array(means) - wanted).max() < 5 * math.sqrt(0.25 / (500 * n)) + 1e-9


def plain(x, statistic, replicates=4000):
    r = np.random.default_rng(1)
    return np.array([statistic(x[r.integers(0, len(x), len(x))]) for _ in range(replicates)])


def farthest(a, b):
    """Kolmogorov distance of two samples."""
    at = np.sort(np.concatenate((a, b)))
    return np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max()


@pytest.mark.parametrize("block_rows", [3, 40, 8192])
def test_replicates_are_distributed_like_plain_resampling(spark, block_rows):
    groups = {"odd": RNG.lognormal(size=101), "even": RNG.normal(size=64), "tied": RNG.integers(0, 4, 90).astype(float), "two": np.array([1.0, 5.0]), "one": np.array([2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("odd", None)], "k string, v double")
    values = B.ordered_values(df, ["k"], "v").cache()
    for statistic, fn in (("median", np.median), ("mean", np.mean)):
        rows = B.replicate_statistics(values, ["k"], statistic, 4000, block_rows=block_rows).collect()
        for k, x in groups.items():
            got = np.array([r.stat for r in rows if r.k == k])
            assert len(got) == 4000 and farthest(np.round(got, 9), np.round(plain(x, fn), 9)) < 0.045, (k, statistic)


def jackknife(x, statistic):
    jack = np.array([statistic(np.delete(x, i)) for i in range(len(x))])
    d = jack.mean() - jack
    return (d ** 3).sum() / (6 * (d ** 2).sum() ** 1.5) if (d ** 2).sum() > 0 else 0.0


@pytest.mark.parametrize("n", [2, 3, 4, 7, 20, 51])
def test_acceleration_from_counts_is_the_jackknifes(spark, n):
    x = np.round(RNG.lognormal(size=n), 1)
    values = B.ordered_values(spark.createDataFrame([(1, float(v)) for v in x], "k int, v double"), ["k"], "v")
    for statistic, fn in (("median", np.median), ("mean", np.mean)):
        row = B.estimates(values, ["k"], statistic).first()
        assert row.n == n and row.estimate == pytest.approx(fn(x)) and row.acc == pytest.approx(jackknife(x, fn), abs=1e-9)


def test_intervals_of_median_and_mean(spark):
    x = RNG.lognormal(size=400)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("few", 1.0), ("few", 3.0), ("none", None)], "k string, v double")
    for statistic, fn in (("median", np.median), ("mean", np.mean)):
        rows = {r.k: r for r in B.bootstrap_interval(df, ["k"], "v", statistic).collect()}
        boots = plain(x, fn, 10_000)
        assert set(rows) == {"a", "few"} and rows["few"].bca_low == rows["few"].ci_high == 2.0
        spread = boots.std()
        assert abs(rows["a"].ci_low - np.percentile(boots, 2.5)) < 0.15 * spread and abs(rows["a"].ci_high - np.percentile(boots, 97.5)) < 0.15 * spread
        again = {r.k: r for r in B.bootstrap_interval(df.repartition(5), ["k"], "v", statistic).collect()}
        for k, row in rows.items():  # the draws hang on group and block only
            assert [v for v in again[k] if v != k] == pytest.approx([v for v in row if v != k])
    assert B.bootstrap_interval(df.limit(0), ["k"], "v").count() == 0


# ---------------------------------------------------------------- prefix scan
def scans(df):
    """Parquet scans, Python functions and joins in the plan before anything is reused."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return len(re.findall(r"FileScan|Scan parquet", plan)), len(re.findall(r"Python|Pandas", plan))


def test_statistics_read_their_input_at_most_twice(spark, sf):
    for name in ("ST-01", "ST-02", "ST-07", "ST-08"):
        assert scans(entry_module.queries()[name](spark, sf))[0] <= 2, name


def test_a_hot_key_is_spread_over_the_partitions(spark):
    """A third of all rows under one key: no partition of the placed rows holds much more than its share."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 7919 % 30_011).alias("t"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = O.place(rows, ["k"], [F.col("t")])
    sizes = [r["count"] for r in placed.rows.groupBy(O.PART).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * 30_000 / 4
    got = O.row_numbers(rows, ["k"], [F.col("t")]).where("k = 0").orderBy("t").collect()
    assert [r.rn for r in got] == list(range(1, 10_001))


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_scans_over_null_and_several_keys(spark, partitions):
    """Null keys are one key, keys of several columns, empty input, states that cross several partitions."""
    r = np.random.default_rng(3)
    data = [(None if i % 5 == 0 else int(r.integers(0, 2)), str(r.integers(0, 2)), i, None if r.random() < 0.9 else f"s{i}", float(r.random())) for i in range(400)]
    df = spark.createDataFrame(data, "a int, b string, t int, s string, x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    summed = {q.t: (q.c, q.n) for q in O.running_sums(df, ["a", "b"], [F.col("t")], {"c": F.col("x"), "n": F.lit(1)}).collect()}
    lead = {q.t: q.p for q in O.neighbour(df, ["a", "b"], ["t"], {"p": "t"}, 1).collect()}
    carried = {q.t: q.p for q in O.carry_forward(df, ["a", "b"], ["t"], "s", "p").collect()}
    none = O.row_numbers(df.limit(0), ["a"], [F.col("t")]).count()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for a, b, t, s, x in data:
        groups.setdefault((a, b), []).append((t, s, x))
    for rows in groups.values():
        total, seen = 0.0, None
        for i, (t, s, x) in enumerate(rows):
            total, seen = total + x, s or seen
            assert summed[t][0] == pytest.approx(total) and summed[t][1] == i + 1 and carried[t] == seen
            assert lead[t] == (rows[i + 1][0] if i + 1 < len(rows) else None)
    assert none == 0
