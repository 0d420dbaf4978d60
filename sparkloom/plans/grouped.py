"""Numpy on many small bounded groups, without one Python call frame per group shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPES = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}
#: Rows whose lists are Python objects at one time.
_ROWS = 256


def _parts(lists: pa.Array) -> list[np.ndarray]:
    """The values of every list as an array of its own."""
    at = lists.offsets.to_numpy()
    values = lists.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)
    return np.split(values, at[1:-1] - at[0])


def _joined(arrays: list, kind: str) -> pa.Array:
    """The values of many rows as one column; numpy's own strings would all be as wide as the longest one."""
    if not arrays:
        return pa.array([], _TYPES[kind])
    return pa.array(np.concatenate([np.asarray(x, object if kind == "string" else None) for x in arrays]), _TYPES[kind])


def list_of_structs(sizes, columns: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for every row; ``sizes`` tells how many structs each row has."""
    items = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)), items)


def map_lists(df: DataFrame, keys: Sequence[str], lists: Sequence[Column], fn: Callable[..., dict], schema: dict[str, str],
              with_key: bool = False) -> DataFrame:
    """Apply ``fn(*arrays) -> {name: values}`` to the lists of every row and explode the results.

    The rows stay where they are; a few hundred of them at a time are numpy arrays.  ``with_key`` puts the first key,
    as text, before the lists.  A row whose first list is empty gives nothing.
    """

    width = len(lists)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo in range(0, len(batch), _ROWS):
                part = batch.slice(lo, _ROWS)
                columns = [_parts(part.field(i + 1)) for i in range(width)]
                names = part.field(0).to_pylist()
                out, sizes = [], []
                for name, *values in zip(names, *columns):
                    found = fn(*([name] if with_key else []), *values) if len(values[0]) else None
                    sizes.append(len(found[next(iter(schema))]) if found else 0)
                    out += [found] if found else []
                yield list_of_structs(sizes, {n: _joined([x[n] for x in out], t) for n, t in schema.items()})

    spec = "array<struct<" + ",".join(f"{n}:{t}" for n, t in schema.items()) + ">>"
    given = F.struct(F.col(keys[0]).cast("string").alias("k"), *[c.alias(f"c{i}") for i, c in enumerate(lists)])
    return df.select(*keys, F.inline(F.arrow_udf(run, spec)(given)))


def map_small_groups(df: DataFrame, key: str, columns: Sequence[str], fn: Callable[..., dict], schema: dict[str, str]) -> DataFrame:
    """Apply ``fn(*column_arrays) -> {name: values}`` to every group and explode the results.

    Only for groups with a bound of their own (the distinct features of one document or one
    sequence).  Groups become array rows, so one Arrow batch carries many groups; that is far
    cheaper than a grouped-map call per group.
    """
    packed = df.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("g"))
    return map_lists(packed, [key], [F.col("g")[c] for c in columns], fn, schema)
