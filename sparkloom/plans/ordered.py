"""Ordered computations (running sums, neighbours, islands, row numbers) that survive hot keys.

A plain window sorts all rows of one key in one task.  When a single key may hold a third of the table that task is
the job.  The helpers here are a prefix scan in two passes over rows that are placed once: range-partitioned by key
and order, sorted inside the partitions and checkpointed, so a hot key spreads over as many partitions as it has rows
for.  The first pass gives one row for each partition (first key, last key, state of the last key), the driver walks
over these few rows to carry the state from partition to partition, and the second pass finishes every row where it
lies.  The input is computed once and joined with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .iterate import cut

BLOCK = "__block"
PART = "__part"


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None,
          rank: str = "rnk") -> DataFrame:
    """First ``k`` rows of every key.

    ``row_number <= k`` is planned with a group limit before the exchange, so a hot key sends
    at most ``k`` rows per map task and the result stays exact.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def quantile_blocks(df: DataFrame, keys: Sequence[str], order: str, blocks: int = 32) -> DataFrame:
    """Add a block number along ``order`` from per-key approximate quantile bounds.

    The bounds are one array of ``blocks - 1`` numbers per key; any bounds give exact results
    downstream, approximate ones only make the blocks slightly uneven.
    """
    probs = [i / blocks for i in range(1, blocks)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(order, probs, 1000).alias("__bounds"))
    return df.join(bounds, list(keys)).withColumn(
        BLOCK, F.size(F.filter("__bounds", lambda b: b < F.col(order)))
    ).drop("__bounds")


@dataclass(frozen=True)
class Placed:
    """Rows in the order of their keys and their order, with the number of their partition."""

    rows: DataFrame
    keys: tuple[str, ...]


def place(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> Placed:
    """Range-partition, sort and checkpoint ``df`` once; every scan over the result reads it as it lies."""
    by = [*[F.col(k) for k in keys], *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id())
    return Placed(cut(rows), tuple(keys))


def _starts(columns: Sequence[pa.Array]) -> np.ndarray:
    """True where a row has another key than the row before it (the first row is left False)."""
    n = len(columns[0])
    new = np.zeros(n, np.bool_)
    for c in columns:
        here, before = c.slice(1), c.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        new[1:] |= differs | (here.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
    return new


def _keyed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple, tuple]]:
    """(batch, starts, key of its first row, key of its last row); keys are the first columns."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = batch.columns[:keys]
        starts = _starts(columns) if keys else np.zeros(batch.num_rows, np.bool_)
        ends = [tuple(c[i].as_py() for c in columns) for i in (0, batch.num_rows - 1)]
        starts[0] = ends[0] != last
        last = ends[1]
        yield batch, starts, *ends


class _Scan:
    """One kind of state: how a batch changes it, and the columns that a batch gains from it."""

    #: State columns: names of the input columns whose types they have.
    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def step(self, values: list[pa.Array], starts: np.ndarray, state: list) -> tuple[list[pa.Array] | None, list]:
        raise NotImplementedError

    def join(self, carried: list, own: list) -> list:
        raise NotImplementedError


class _Sums(_Scan):
    """Inclusive running sums."""

    def step(self, values, starts, state):
        group = np.cumsum(starts)
        out, ends = [], []
        for v, s in zip(values, state):
            x = pc.fill_null(v, 0).to_numpy(zero_copy_only=False)
            x = x.copy()
            if not starts[0] and s is not None:
                x[0] += s
            run = pd.Series(x).groupby(group).cumsum().to_numpy()
            out.append(pa.array(run, v.type))
            ends.append(run[-1].item())
        return out, ends

    def join(self, carried, own):
        return [(a or 0) + (b or 0) for a, b in zip(carried, own)]


class _Lag(_Scan):
    """Values of the row before."""

    def step(self, values, starts, state):
        out = []
        for v, s in zip(values, state):
            moved = pa.concat_arrays([pa.array([s], v.type), v.slice(0, len(v) - 1)])
            out.append(pc.if_else(pa.array(starts), pa.scalar(None, v.type), moved))
        return out, [v[len(v) - 1].as_py() for v in values]

    def join(self, carried, own):
        return own


class _Carry(_Scan):
    """Last value so far that is not null."""

    def step(self, values, starts, state):
        out, ends = [], []
        for v, s in zip(values, state):
            n = len(v)
            at = np.arange(1, n + 1)
            first = np.maximum.accumulate(np.where(starts, at, 0))
            seen = np.maximum.accumulate(np.where(v.is_valid().to_numpy(zero_copy_only=False), at, 0))
            known = pa.concat_arrays([pa.array([s], v.type), v])
            taken = known.take(pa.array(np.where(seen >= first, seen, 0)))
            out.append(pc.if_else(pa.array((seen >= first) & ((seen > 0) | (first == 0))), taken, pa.scalar(None, v.type)))
            ends.append(out[-1][n - 1].as_py())
        return out, ends

    def join(self, carried, own):
        return [a if b is None else b for a, b in zip(carried, own)]


def _scan(placed: Placed, scan: _Scan, names: Sequence[str]) -> Placed:
    """``placed`` with a column for each of the scan's columns, named by ``names``."""
    rows, keys, width = placed.rows, placed.keys, len(scan.columns)
    types = [rows.schema[c].dataType for c in scan.columns]
    state_fields = [T.StructField(f"s{i}", t) for i, t in enumerate(types)]
    key_fields = [T.StructField(f"{end}{i}", rows.schema[k].dataType) for end in ("first", "last") for i, k in enumerate(keys)]
    summary = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("single", T.BooleanType()), *key_fields, *state_fields])

    def ends(batches):
        head, state, single, part, last = None, [None] * width, True, None, None
        for batch, starts, first, last in _keyed(batches, len(keys)):
            if head is None:
                head, part = first, batch.column(len(keys) + width)[0].as_py()
                single = not starts[1:].any()
            else:
                single &= not starts.any()
            _, state = scan.step(batch.columns[len(keys):len(keys) + width], starts, state)
        if head is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(summary.names, (part, single, *head, *last, *state)))], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(summary)
    thin = rows.select(*keys, *scan.columns, PART)
    found = thin.mapInArrow(ends, summary).collect()  # one row for each partition
    carried, state, before = {}, None, None
    for r in sorted(found, key=lambda r: r.part):
        n = len(keys)
        first, last, own = tuple(r[2:2 + n]), tuple(r[2 + n:2 + 2 * n]), list(r[2 + 2 * n:])
        if state is not None and before == first:
            carried[r.part] = state
            own = scan.join(state, own) if r.single else own
        state, before = own, last

    columns, place_of = rows.columns, {c: i for i, c in enumerate(rows.columns)}
    order = [place_of[k] for k in keys] + [place_of[c] for c in scan.columns] + [place_of[PART]]

    def finish(batches):
        state, begun, held = [None] * width, False, []
        front = (b.select(order) for b in _held(batches, held))
        for batch, starts, _, _ in _keyed(front, len(keys)):
            if not begun:
                begun = True
                state = carried.get(batch.column(len(keys) + width)[0].as_py())
                starts[0] = state is None
                state = state or [None] * width
            out, state = scan.step(batch.columns[len(keys):len(keys) + width], starts, state)
            yield pa.RecordBatch.from_arrays([*held.pop().columns, *out], names=[*columns, *names])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in zip(names, types)]])
    return Placed(rows.mapInArrow(finish, schema), keys)


def _held(batches: Iterator[pa.RecordBatch], held: list) -> Iterator[pa.RecordBatch]:
    """The batches that hold rows, each put into ``held`` as it goes by."""
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield batch


def _clean(placed: Placed, *helpers: str) -> DataFrame:
    return placed.rows.drop(PART, *helpers)


def _numbers(df: DataFrame, values: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """Helper columns of the values as long (whole numbers) or double."""
    names = [f"__v{i}" for i in range(len(values))]
    df = df.withColumns(dict(zip(names, values)))
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return df.withColumns({n: F.col(n).cast("long" if isinstance(df.schema[n].dataType, whole) else "double") for n in names}), names


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                 sums: dict[str, Column], block: Column | None = None) -> DataFrame:
    """Inclusive running sums ``{output: value}`` per key; a null adds nothing.

    ``block``, a stretch of the order, is no longer needed and has no effect.
    """
    df, helpers = _numbers(df, list(sums.values()))
    return _clean(_scan(place(df, keys, order), _Sums(helpers), list(sums)), *helpers)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column | None = None,
                name: str = "rn") -> DataFrame:
    """Exact row numbers per key (from 1) without sorting a key in one task."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")})


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str],
              step: int = 1, block: Column | None = None) -> DataFrame:
    """``lag`` (step -1) or ``lead`` (step +1) of columns; ``values`` maps output name to source column."""
    if step not in (1, -1):
        raise ValueError("step must be 1 or -1")
    by = [F.asc(c) if step == -1 else F.desc(c) for c in order]
    return _clean(_scan(place(df, keys, by), _Lag(list(values.values())), list(values)))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], source: str, name: str,
                  block: Column | None = None) -> DataFrame:
    """Last non-null value seen so far per key (an as-of fill)."""
    return _clean(_scan(place(df, keys, [F.col(c) for c in order]), _Carry([source]), [name]))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, eps: float,
            block: Column | None = None, name: str = "island") -> DataFrame:
    """Gaps-and-islands: a new island starts where the step from the previous row exceeds ``eps``.

    Both scans, for the row before and for the running number of starts, read the rows as they were placed.
    """
    before = _scan(place(df, keys, [F.col(c) for c in order]), _Lag([position]), ["__prev"])
    start = F.when(F.col("__prev").isNull() | (F.col(position) - F.col("__prev") > eps), 1).otherwise(0).cast("long")
    marked = Placed(before.rows.withColumn("__start", start), before.keys)
    return _clean(_scan(marked, _Sums(["__start"]), [name]), "__prev", "__start")
