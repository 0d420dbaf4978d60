"""Structured Streaming forms: field assembly, totals, windows, early emission, deduplication, fan-in."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import TimestampNTZType

from ..operators.sensors import controller
from ..plans.tables import epoch_us


def _pack(ids: np.ndarray, until: np.ndarray, done: np.ndarray, got: np.ndarray) -> bytes:
    """The sessions of a group as compressed Arrow bytes."""
    columns = [pa.array(x) for x in (ids, until, done)] + [pa.array(c, pa.string()) for c in got.T]
    batch = pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(state: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, until, done, *got = (c.to_numpy(zero_copy_only=False) for c in pa.ipc.open_stream(bytes(state)).read_next_batch().columns)
    return ids, until, done, np.stack(got, axis=1).astype(object)


def assemble_fields(stream: DataFrame, key: str, field: str, value: str, expected: Sequence[str], ts: str | None = None,
                    timeout_s: int = 300, fallback: str | None = None, order: str | None = None, groups: int = 512) -> DataFrame:
    """One row per session once all expected fields have arrived.

    The first value of a field wins: by event time within a batch, by batch between batches (values at the same
    time: the smaller).  Without ``order`` or ``ts`` the smallest value of the batch is the first.

    With an event-time column (under a watermark) a session that stays incomplete for ``timeout_s``
    after its last row is emitted with ``timed_out`` set and its missing fields filled by the fallback.
    State is one small row per session; with a time limit it is dropped once the limit has passed, and
    until then a finished session is remembered so that repeats do not emit it again.

    Sessions are dealt into ``groups`` by a hash of their key, and the rows of a group's sessions lie together in its
    state: Python is called for a group, not for each session.  A group's timer is that of its earliest session.
    """
    names, at = list(expected), "__r" if order or ts else None
    slots = {n: i for i, n in enumerate(names)}
    out = f"{key} long, " + ", ".join(f"{n} string" for n in names) + ", n_ready int, timed_out boolean"

    def emit(k, ids, got, late) -> pd.DataFrame:
        missing = np.equal(got, None)
        ready = len(names) - missing.sum(axis=1)
        if late:
            got = np.where(missing, fallback, got)
        return pd.DataFrame({key: ids if k >= 0 else [None] * len(ids), **{n: got[:, i] for i, n in enumerate(names)},
                             "n_ready": ready, "timed_out": late})

    def step(k: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        now = max(st.getCurrentWatermarkMs(), 0) if ts is not None else 0
        best, last = None, pd.Series(dtype="int64")
        for pdf in () if st.hasTimedOut else batches:
            ms = pdf["__us"].fillna(0) // 1000 if ts is not None else pd.Series(0, pdf.index)
            last = pd.concat([last, ms.astype("int64").groupby(pdf["__k"]).max()]).groupby(level=0).max()
            hits = pdf[pdf["__f"].isin(names) & pdf["__v"].notna()]
            best = pd.concat([best, hits]).sort_values([*([at] if at else []), "__v"]).drop_duplicates(["__k", "__f"])

        old, until, done, got = _unpack(st.get[0]) if st.exists else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool),
                                                                      np.zeros((0, len(names)), object))
        ids = np.union1d(old, last.index.to_numpy(np.int64))
        kept, known = np.searchsorted(ids, old), (until, done, got)
        until, done, got = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), np.full((len(ids), len(names)), None, object)
        until[kept], done[kept], got[kept] = known
        if best is not None:
            row, col = np.searchsorted(ids, best["__k"].to_numpy(np.int64)), best["__f"].map(slots).to_numpy(np.int64)
            new = np.equal(got[row, col], None) & ~done[row]
            got[row[new], col[new]] = best["__v"].to_numpy(object)[new]
            full = ~done & ~np.equal(got, None).any(axis=1)
            if full.any():
                yield emit(k[0], ids[full], got[full], False)
            done |= full
            got[done] = None
        if ts is not None:
            row = np.searchsorted(ids, last.index.to_numpy(np.int64))
            until[row] = np.maximum(until[row], np.maximum(last.to_numpy(), now) + timeout_s * 1000)
            over = until < now
            if (over & ~done).any():
                yield emit(k[0], ids[over & ~done], got[over & ~done], True)
            ids, until, done, got = ids[~over], until[~over], done[~over], got[~over]
        if not len(ids):
            st.remove()
            return
        st.update((_pack(ids, until, done, got),))
        if ts is not None:
            st.setTimeoutTimestamp(int(until.min()))

    kind = GroupStateTimeout.NoTimeout if ts is None else GroupStateTimeout.EventTimeTimeout
    cols = [F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups))).cast("int").alias("__g"),
            F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("__k"), F.col(field).alias("__f"), F.col(value).alias("__v")]
    if ts is not None:  # the column itself carries the watermark
        us = epoch_us(ts) if isinstance(stream.schema[ts].dataType, TimestampNTZType) else F.unix_micros(ts)
        cols += [F.col(ts), us.alias("__us")] + ([] if order else [us.alias("__r")])
    if order:
        cols.append(F.col(order).alias("__r"))
    return stream.select(*cols).groupBy("__g").applyInPandasWithState(step, out, "sessions binary", "append", kind)


def assemble_fields_batch(df: DataFrame, key: str, field: str, value: str, order: str, expected: Sequence[str]) -> DataFrame:
    """Batch twin: complete sessions by one conditional aggregation."""
    cols = [F.min_by(value, F.when(F.col(field) == n, F.col(order))).alias(n) for n in expected]
    out = df.groupBy(key).agg(*cols)
    for n in expected:
        out = out.where(F.col(n).isNotNull())
    return out


def running_total(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Totals that grow as sources report (use output mode *update* or *complete*)."""
    return stream.groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def stream_controller(stream: DataFrame, ts: str, value: str, key: str, window: str = "1 hour", slide: str | None = None,
                      late: str = "10 minutes", limit: float = 1.0, session_gap: str | None = None) -> DataFrame:
    """Windowed average power and the threshold command; late rows are bounded by the watermark.

    Tumbling by default, sliding with ``slide``, session windows with ``session_gap``.
    """
    w = F.session_window(ts, session_gap) if session_gap else F.window(ts, window, slide or window)
    agg = stream.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.avg(value).alias("average_power"), F.count("*").alias("n"))
    return controller(agg, limit)


def stream_short_circuit(stream: DataFrame, key: str, status: str, order: str, ts: str | None = None, ttl_s: int | None = None) -> DataFrame:
    """Emit a machine's first CRITICAL row at once; later rows of that machine are ignored.

    With an event-time column (under a watermark) and a time to live, a machine is forgotten once the watermark has
    passed its last critical row by that time, so state does not grow with the machines ever seen; a later critical
    row of it is then a first one again.  Without them every machine is remembered for good.
    """
    schema = f"{key} long, {order} long"
    bounded = ts is not None and ttl_s is not None

    def step(k: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        if st.hasTimedOut:
            st.remove()
            return
        first, last = None, st.getCurrentWatermarkMs() if bounded else 0
        for pdf in batches:
            if len(pdf):
                first = min(int(pdf[order].min()), first if first is not None else int(pdf[order].min()))
                last = max(last, int(pdf[ts].max().timestamp() * 1000)) if bounded else last
        if first is None:
            return
        if not st.exists:
            yield pd.DataFrame({key: [k[0]], order: [first]})
        st.update((True,))
        if bounded:
            st.setTimeoutTimestamp(last + ttl_s * 1000)

    critical = stream.where(F.col(status) == "CRITICAL_STOP").select(key, order, *([ts] if bounded else []))
    kind = GroupStateTimeout.EventTimeTimeout if bounded else GroupStateTimeout.NoTimeout
    return critical.groupBy(key).applyInPandasWithState(step, schema, "fired boolean", "append", kind)


def stream_dedupe(stream: DataFrame, keys: Sequence[str], ts: str, within: str = "1 hour") -> DataFrame:
    """Drop repeats of at-least-once delivery; state is bounded by the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def stream_fan_in(early: DataFrame, late: DataFrame, key: str, early_ts: str, late_ts: str, within: str = "1 hour",
                  watermark: str = "10 minutes") -> DataFrame:
    """Left outer join of two streams on the session within a time bound.

    Both sides carry watermarks, so unmatched early rows are released once no partner can come.
    """
    a = early.withWatermark(early_ts, watermark)
    b = late.withWatermark(late_ts, watermark).withColumnRenamed(key, "__k")
    bound = (F.col(late_ts) >= F.col(early_ts)) & (F.col(late_ts) <= F.col(early_ts) + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col("__k")) & bound, "leftOuter").drop("__k")


def fan_in_batch(early: DataFrame, late: DataFrame, key: str, early_ts: str, late_ts: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Batch twin: an interval join on (key, hour), so one busy key is spread over time buckets."""
    b = late.withColumnRenamed(key, "__k").withColumn("__b", F.floor(F.col(late_ts) / bucket_us))
    spread = early.select("*", F.explode(F.array(F.floor(F.col(early_ts) / bucket_us), F.floor(F.col(early_ts) / bucket_us) + 1)).alias("__b"))
    hit = (F.col(key) == F.col("__k")) & (spread["__b"] == b["__b"]) & (F.col(late_ts) >= F.col(early_ts)) & (
        F.col(late_ts) <= F.col(early_ts) + bucket_us)
    matched = spread.join(b, hit).drop("__b", "__k")
    seen = matched.select(*[F.col(c).alias(f"__m_{c}") for c in early.columns]).distinct()
    same = [early[c].eqNullSafe(seen[f"__m_{c}"]) for c in early.columns]
    alone = early.join(seen, functools.reduce(lambda x, y: x & y, same), "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def item_pipeline(df: DataFrame, value: str = "value") -> DataFrame:
    """value -> processed -> analysed, scored, categorised -> graded; batch and streaming alike."""
    p = F.col(value) * 2 + 100
    d = df.withColumn("processed_value", p)
    d = d.withColumn("analyzed_value", F.floor(F.sqrt("processed_value") * 10)).withColumn(
        "score", F.least(F.lit(100), F.floor(F.col("processed_value") / 10))).withColumn(
        "category", F.when(F.col("processed_value") > 500, "high").when(F.col("processed_value") > 200, "medium").otherwise("low"))
    s = F.col("score")
    return d.withColumn("grade", F.when(s >= 80, "A").when(s >= 60, "B").when(s >= 40, "C").otherwise("D"))


def grade_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("grade").agg(F.count("*").alias("n"), F.sum("score").alias("total_score"))
