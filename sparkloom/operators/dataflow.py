"""Dataflow patterns: map, fan-out, fan-in, conditions, exactly-one-result, fallback."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_lookup
from ..plans.ordered import neighbour


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply steps one after another; the optimiser sees one plan."""
    for step in steps:
        df = df.transform(step)
    return df


def fan_out_map(df: DataFrame, array: Column, keep: Sequence[str]) -> DataFrame:
    """One row per element with its index and the collection size.

    The size travels inside the elements; next to the explode it would drag the whole collection
    into every row.
    """
    named = df.select(*keep, array.alias("__a"))
    return named.select(*keep, F.inline(F.transform("__a", lambda x, i: F.struct(
        F.size("__a").alias("size"), i.alias("index"), x.alias("value")))))


def fan_out(df: DataFrame, branches: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """Give one input to several branches.

    Branches are expressions over the same row, so the input is scanned once and rows are
    multiplied inside the stage; branch results share one type.
    """
    rows = F.array(*[
        F.struct(F.lit(name).alias("branch"), F.lit(i).alias("index"), F.lit(len(branches)).alias("size"),
                 value.alias("value"))
        for i, (name, value) in enumerate(branches.items())
    ])
    return df.select(*keep, F.inline(rows))


def fan_in(branches: dict[str, DataFrame], key: str, optional: Sequence[str] = ()) -> DataFrame:
    """Join named branches on the session key; optional branches may be missing.

    Every branch is hash-partitioned on the same key, so the joins share one partitioning.
    """
    names = [n for n in branches if n not in optional] + [n for n in branches if n in optional]
    out = branches[names[0]]
    for name in names[1:]:
        out = out.join(branches[name], key, "left" if name in optional else "inner")
    return out


def gather(df: DataFrame, keys: Sequence[str], index: str, value: str, chunk: int = 1000) -> DataFrame:
    """Ordered collections per key, cut into stretches of ``chunk`` indices.

    A key with few elements gives one row (chunk 0).  A hot key gives many bounded rows on many
    tasks instead of one unbounded array; nothing is dropped.
    """
    part = F.floor(F.col(index) / chunk).alias("chunk")
    items = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v"))))
    return df.groupBy(*keys, part).agg(F.transform(items, lambda s: s["v"]).alias("values"))


def complete_sessions(df: DataFrame, key: str, index: str, size: str) -> DataFrame:
    """Sessions for which every index of the announced size has arrived (duplicates count once)."""
    seen = df.groupBy(key, index).agg(F.max(size).alias(size))
    return seen.groupBy(key).agg(F.count("*").alias("n_ready"), F.max(size).alias(size)).where(
        F.col("n_ready") == F.col(size))


def pairwise(df: DataFrame, keys: Sequence[str], index: str, value: str, chunk: int = 1000) -> DataFrame:
    """Every element with its successor; the last element of a session has none and is dropped."""
    out = neighbour(df, keys, [index], {"next_value": value, "next_index": index}, 1,
                    F.floor(F.col(index) / chunk))
    return out.where(F.col("next_index").isNotNull()).select(*keys, index, value, "next_value")


def branch_if(df: DataFrame, cond: Column, then: Callable, otherwise: Callable) -> DataFrame:
    """Route rows to one of two steps; a null condition takes the second."""
    yes = F.coalesce(cond, F.lit(False))
    return then(df.where(yes)).unionByName(otherwise(df.where(~yes)))


def where_index(df: DataFrame, key: str, index: str, condition: str) -> DataFrame:
    """Keep elements by a condition over their index and the collection size."""
    sizes = df.groupBy(key).agg(F.count("*").alias("size"))
    return df.join(sizes, key).where(F.expr(condition))


def nested_map(df: DataFrame, outer: Column, inner: Callable[[Column], Column], keep: Sequence[str]) -> DataFrame:
    """Map inside map: one index column per level."""
    first = df.select(*keep, F.posexplode(outer).alias("i1", "__o"))
    return first.select(*keep, "i1", F.posexplode(inner(F.col("__o"))).alias("i0", "value"))


def pop_level(df: DataFrame, keys: Sequence[str], inner: str = "i0", value: str = "value", chunk: int = 1000) -> DataFrame:
    """Collapse the inner level, keep the outer one."""
    return gather(df, keys, inner, value, chunk)


def case_branch(rules: Sequence[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def map_array(array: Column, fn: Callable[[Column], Column]) -> Column:
    return F.transform(array, fn)


def short_circuit(fast: DataFrame, slow_input: DataFrame, slow: Callable[[DataFrame], DataFrame], key: str,
                  ok: str) -> DataFrame:
    """Run the slow branch only for keys that the fast branch accepted; rejected keys stay with nulls.

    The semi join cuts the slow branch's input before any of its own shuffles; its result meets one pass of the
    fast branch, whose rejected rows match nothing.
    """
    done = slow(slow_input.join(fast.where(F.col(ok)).select(key), key, "left_semi")).withColumnRenamed(key, "__k")
    accepted = F.coalesce(F.col(ok), F.lit(False))
    return fast.join(done, (F.col(key) == F.col("__k")) & accepted, "left").drop("__k")


def first_completed(df: DataFrame, key: str, ts: str, branch: str, payload: Sequence[str]) -> DataFrame:
    """The branch that finished first per key; an aggregate, so a hot key is combined map-side."""
    best = F.min_by(F.struct(ts, branch, *payload), F.struct(ts, branch, *payload)).alias("b")
    return df.groupBy(key).agg(best).select(key, "b.*")


def readiness(keys: DataFrame, key: str, branches: Sequence[str], done: DataFrame, branch: str) -> DataFrame:
    """Ready and missing branches per session, in branch order."""
    flags = [F.bool_or(F.col(branch) == b).alias(f"__b{i}") for i, b in enumerate(branches)]
    seen = done.groupBy(key).agg(*flags)
    out = keys.select(key).distinct().join(seen, key, "left")
    states = F.array(*[F.struct(F.lit(b).alias("b"), F.coalesce(F.col(f"__b{i}"), F.lit(False)).alias("r"))
                       for i, b in enumerate(branches)])
    pick = lambda want: F.transform(F.filter(states, lambda s: s["r"] == want), lambda s: s["b"])
    return out.select(key, pick(F.lit(True)).alias("ready"), pick(F.lit(False)).alias("missing"))


def dedupe_results(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One result per key: the first by ``order``.

    ``min_by`` keeps one row per key and map task, so repeats of a hot key never meet in one sort.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, "b.*")


def split_errors(df: DataFrame, value: Column, name: str = "result") -> tuple[DataFrame, DataFrame]:
    """Good rows and failed rows of an expression that gives null on failure."""
    tried = df.withColumn(name, value)
    return tried.where(F.col(name).isNotNull()), tried.where(F.col(name).isNull()).drop(name)


def with_fallback(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill missing fields and report which ones had arrived."""
    cols = [c for c in df.columns if c not in defaults]
    return df.select(
        *cols, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()],
        *[F.col(c).isNotNull().alias(f"{c}_ready") for c in defaults])


def merge_maps(df: DataFrame, keys: Sequence[str], entry: str, index: str, value: str) -> DataFrame:
    """Union of maps as entry rows; on equal entries the last index wins."""
    return df.groupBy(*keys, entry).agg(F.max_by(value, index).alias(value))


def merge_dedupe_rank(results: Sequence[DataFrame], key: str, score: str, k: int) -> DataFrame:
    """Merge several ranked lists, keep each id's best score, return the best ``k``."""
    merged = results[0]
    for other in results[1:]:
        merged = merged.unionByName(other)
    best = merged.groupBy(key).agg(F.max(score).alias(score))
    return best.orderBy(F.desc(score), F.asc(key)).limit(k)


def enrich(df: DataFrame, lookups: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Left-join lookups one after another, each broadcast only while its size allows."""
    for lookup, key in lookups:
        df = join_lookup(df, lookup, key)
    return df
