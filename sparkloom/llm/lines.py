"""Line dedup by winnowing over line hashes.

Every window of ``run`` consecutive lines selects its smallest line hash (the last one on ties) as fingerprint,
so two equal runs of at least ``run`` lines always share a selected fingerprint at the same place of the run.
Fingerprints that occur at one position only are dropped.  They are a filter, nothing is extended from them:
every window that selected a shared one is compared by its lines with the first window of the same lines.
Matched windows overlap line by line, so their union is the
maximal repeated run, even one pieced together from several earlier documents.

With ``words``, fewer lines that hold as many words are windows as well, so that a long passage is found in one
or two lines.  A window that two smaller ones cover is left out: where it repeats, they do.

Joins go through the first occurrence of a fingerprint and of a window, found with map-side aggregation: a line
that a third of all documents hold yields one row for each of its occurrences, never a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import fresh, keep

_NOT_BREAK = np.ones(256, np.bool_)
_NOT_BREAK[0x0A] = False
_INK = np.ones(256, np.bool_)
_INK[[0x20, 0x09, 0x0B, 0x0C, 0x0D, 0x0A]] = False


def _lines(raw: np.ndarray, offsets: np.ndarray):
    """(start, end, text number, hash, words) of every line that is not blank; A-Z and outer white space do not count."""
    data = _text.LOWER[raw]
    starts, ends, doc = _text.tokens(_NOT_BREAK, data, offsets)
    ink = np.flatnonzero(_INK[data])
    lo, hi = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    full = hi > lo
    starts, ends, doc, lo, hi = starts[full], ends[full], doc[full], lo[full], hi[full]
    gaps = np.cumsum(np.diff(ink, prepend=-1) > 1)
    return starts, ends, doc, _text.span_hashes(_text.prefix_sums(data), ink[lo], ink[hi - 1] + 1), gaps[hi - 1] - gaps[lo] + 1


def _text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def _starts(doc: np.ndarray, counts: np.ndarray, run: int, words: int | None):
    """(lines, first lines) of the windows: ``run`` lines, or fewer with ``words`` words, that no two smaller ones cover."""
    total = np.concatenate(([0], np.cumsum(counts)))
    smaller = np.zeros(len(doc) + 1, np.bool_)
    for size in range(1, run + 1):
        n = max(len(doc) - size + 1, 0)
        full = doc[:n] == doc[size - 1:]
        if size < run:
            full &= total[size:] - total[:n] >= words if words is not None else False
        yield size, np.flatnonzero(full & ~(smaller[:n] & smaller[1:n + 1]))
        smaller = np.append(full, np.zeros(size, np.bool_))


def windows(docs: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """(doc_id, h, at, f, fat, lines): every window with its position, fingerprint and the hashes of its lines."""

    def select(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for lo, hi, raw, offsets in _text.blocks(batch.column(2)):
                _, _, doc, h, counts = _lines(raw, offsets)
                for size, ok in _starts(doc, counts, run, words):
                    if not len(ok):
                        continue
                    stack = np.stack([h[ok + j] for j in range(size)], axis=1)
                    pick = size - 1 - np.argmin(stack[:, ::-1], axis=1)
                    first = np.searchsorted(doc, doc[ok])
                    rows = pa.array(doc[ok] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(rows), hashes.take(rows), pa.array((ok - first).astype(np.int32)),
                         pa.array(stack[np.arange(len(ok)), pick].view(np.int64)), pa.array((ok - first + pick).astype(np.int32)),
                         _text.list_array(stack.reshape(-1).view(np.int64), np.full(len(ok), size), pa.int64())],
                        names=["doc_id", "h", "at", "f", "fat", "lines"])

    rows = docs.select(F.col("doc_id").cast("long"), _text_hash(), F.col("text").cast("string"))
    return rows.mapInArrow(select, "doc_id long, h long, at int, f long, fat int, lines array<long>")


def repeats(docs: DataFrame, run: int = 3, words: int | None = None) -> DataFrame:
    """(doc_id, h, at list): starts and lines of all windows that also stand earlier, by (doc_id, text hash, position)."""
    rows = keep(windows(docs, run, words), "line-windows")
    place = F.struct("doc_id", "h", "fat")
    shared = rows.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("f")
    found = rows.join(shared, "f", "left_semi").select("doc_id", "h", "at", "lines")
    first = found.groupBy("lines").agg(F.min(F.struct("doc_id", "h", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = found.join(first, "lines").where(~F.col("first").eqNullSafe(F.struct("doc_id", "h", "at")))
    return later.groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", F.size("lines").alias("n"))).alias("at"))


def _covered(n: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, run: int = 3, drop_emptied: bool = False, words: int | None = None) -> DataFrame:
    """``docs`` (all columns) with later repeated runs cut from ``text``, and n_lines, n_removed, n_runs added.

    A line goes when it lies in a run of at least ``run`` lines (blank lines do not count), or with ``words`` in a
    run of any number of lines with at least as many words, that also stands
    earlier: in a document with a smaller id, or before in the same one; overlaps count.  Blank lines stay.
    Null stays null and, like an empty text or one of fewer lines, has nothing to lose.  Rows equal in id and
    text are one document; rows with a null id are never cut.  Input columns named like the added ones are replaced.  ``drop_emptied`` drops documents that lose all
    their lines.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    names = docs.columns
    key, own, at_name, mark = fresh(docs, "id", "hash", "at", "h")
    found = repeats(docs, run, words).select(F.col("doc_id").alias(key), F.col("h").alias(own), F.col("at").alias(at_name))
    known = docs.withColumn(mark, _text_hash())
    joined = known.join(found, (F.col("doc_id").cast("long") == F.col(key)) & (F.col(mark) == F.col(own)), "left").select(*names, at_name)
    place, width = names.index("text"), len(names)

    def cut(batches):
        for batch in batches:
            column, at = batch.column(place), batch.column(width)
            texts: dict[int, str] = {}
            counts = np.zeros((batch.num_rows, 3), np.int64)
            for lo, hi, raw, offsets in _text.blocks(column):
                starts, ends, doc, _, _ = _lines(raw, offsets)
                counts[lo:hi, 0] = np.bincount(doc, minlength=hi - lo)
                for row in range(lo, hi):
                    if not at[row].is_valid:
                        continue
                    a, b = np.searchsorted(doc, [row - lo, row - lo + 1])
                    found = at.slice(row, 1).flatten()
                    gone = _covered(b - a, found.field(0).to_numpy(), found.field(1).to_numpy())
                    stay = np.ones(offsets[row - lo + 1] - offsets[row - lo] + 1, np.bool_)
                    base = offsets[row - lo]
                    for i in np.flatnonzero(gone) + a:
                        stay[starts[i] - base:ends[i] - base + 1] = False  # with its line break
                    text = raw[base:offsets[row - lo + 1]]
                    texts[row] = text[stay[:-1]].tobytes().decode()
                    if not stay[-2] and text[-1] != 0x0A and texts[row].endswith("\n"):
                        texts[row] = texts[row][:-1]  # the last line went, the break before it goes too
                    counts[row, 1:] = gone.sum(), len(_text.runs(gone)[0])
            arrays = list(batch.columns)[:width]
            if texts:
                values = column.to_pylist()
                for row, text in texts.items():
                    values[row] = text
                arrays[place] = pa.array(values, column.type)
            out = pa.RecordBatch.from_arrays([*arrays, *[pa.array(counts[:, j]) for j in range(3)]],
                                             names=[*names, "n_lines", "n_removed", "n_runs"])
            yield out.filter(pa.array((counts[:, 1] == 0) | (counts[:, 1] < counts[:, 0]))) if drop_emptied else out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(cut, f"{schema}, n_lines long, n_removed long, n_runs long")
