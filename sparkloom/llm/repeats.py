"""Removal of long repeated byte strings with run-length indexes over a repetitive corpus.

A byte goes when it is covered by a string of ``length`` bytes that also starts in a document with a smaller id.

1.  Every window of ``length`` bytes selects the least hash among its ``anchor``-byte strings, so equal windows
    select equal anchors.  Anchors of one document only are dropped (they are packed before the shuffle, and an
    anchor that several documents of one batch hold travels once).
2.  Around the other anchors the windows are cut out as *contexts* of bounded size.  Equal contexts count once,
    with their least document.
3.  Contexts are grouped by anchor into groups of bounded size, and each group gets a run-length
    Burrows-Wheeler index (``rindex``) through which its contexts are streamed: the matching statistics give for
    every window the least document that holds it.
4.  Windows whose least document is smaller are marked and cut from the texts.

An anchor with more contexts than one group takes is cut into single windows, which are counted by content.
Copies of a whole text are marked by their digest and leave after step 1.  Steps 2 to 4 go over the range of the
anchor hashes in slices, so that no more than one slice takes room on disk at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import discard, keep, release

GROUP_ANCHORS, GROUP_BYTES, HOT_CONTEXTS, CONTEXT_WINDOWS, SLICES = 1_000_000, 600_000, 8_000, 60, 4
KNOWN_PAIRS = 200_000


def _anchors(raw: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """(first window, last window, 48-bit anchor hash, text number) of runs of windows with the same anchor."""
    windows = len(raw) - length + 1
    if windows <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    n = len(raw) - anchor + 1
    least = _text.span_hashes(_text.prefix_sums(raw), np.arange(n), np.arange(anchor, n + anchor))
    width, have = length - anchor + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:have - width], least[width - have:])
    doc = np.searchsorted(offsets, np.arange(windows), side="right") - 1
    at = np.flatnonzero(np.arange(windows) + length <= offsets[doc + 1])
    h, doc = (least[at] >> np.uint64(16)).astype(np.int64), doc[at]
    new = np.ones(len(at), np.bool_)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % CONTEXT_WINDOWS == 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] if len(at) else at, h[first], doc[first]


def _packed(texts: DataFrame, length: int, anchor: int, groups: int) -> DataFrame:
    """Anchors of whole batches, a row for each group of the hash range."""

    def pack(batches):
        for batch in batches:
            hs, ds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, _, raw, offsets in _text.blocks(batch.column(1)):
                _, _, h, doc = _anchors(raw, offsets, length, anchor)
                hs.append(h)
                ds.append(doc + lo)
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            h, doc = np.concatenate(hs), np.concatenate(ds)
            order = np.lexsort((ids[doc], h))
            h, doc = h[order], ids[doc[order]]
            same_h = np.concatenate(([False], h[1:] == h[:-1]))
            fresh = ~(same_h & np.concatenate(([False], doc[1:] == doc[:-1])))
            h, doc, same_h = h[fresh], doc[fresh], same_h[fresh]
            known_h, known_doc = h[same_h], doc[same_h]  # shared inside the batch
            several = np.append(same_h[1:], False)[~same_h].astype(np.int64)
            h, doc = h[~same_h], doc[~same_h]
            names, place = np.unique(doc, return_inverse=True)
            group = h * groups >> 48 if groups < 1 << 15 else (h.astype(object) * groups >> 48).astype(np.int64)
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            rows = []
            for a, b in zip(cuts, np.append(cuts[1:], len(h))):
                used, inner = np.unique(place[a:b], return_inverse=True)
                step = np.diff(h[a:b], prepend=h[a])
                small = step.max() < 1 << 32
                rows.append((int(group[a]), int(h[a]), step.astype("<u4" if small else "<u8").tobytes(),
                             (inner * 2 + several[a:b]).astype("<u2" if len(used) < 1 << 15 else "<u4").tobytes(),
                             names[used], np.zeros(0, np.int64), np.zeros(0, np.int64)))
            # these need to meet nothing: their bucket only spreads them
            heads = _text.mix(known_h[::KNOWN_PAIRS].astype(np.uint64)) + known_doc[::KNOWN_PAIRS].astype(np.uint64)
            for i, bucket in enumerate((_text.mix(heads) % np.uint64(groups)).tolist()):
                empty, some = np.zeros(0, np.int64), slice(i * KNOWN_PAIRS, (i + 1) * KNOWN_PAIRS)
                rows.append((bucket, 0, b"", b"", empty, known_h[some], known_doc[some]))
            longs = pa.list_(pa.int64())
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), longs, longs, longs]
            for a in range(0, len(rows), 16):
                columns = list(zip(*rows[a:a + 16]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=["bucket", "base", "steps", "places", "ids", "known_h", "known_doc"])

    return texts.mapInArrow(pack, "bucket int, base long, steps binary, places binary, ids array<long>, known_h array<long>, known_doc array<long>")


def _shared_anchors(packed: DataFrame) -> DataFrame:
    """(doc_id, h) of every anchor that two documents hold."""

    def meet(table):
        hs, ds, several, out_h, out_d = [], [], [], [], []
        for name, out in (("known_h", out_h), ("known_doc", out_d)):
            out += [c.flatten().to_numpy() for c in table[name].chunks]
        table = table.select(["base", "steps", "places", "ids"])
        for row in (x for batch in table.to_batches() for x in zip(*batch.columns)):
            if len(row[1].as_buffer()):
                base, steps, places, ids = row[0].as_py(), row[1].as_buffer(), row[2].as_buffer(), row[3].values.to_numpy()
                for kind in ("<u4", "<u8"):
                    step = np.frombuffer(steps, kind)
                    place = np.frombuffer(places, "<u2" if len(ids) < 1 << 15 else "<u4").astype(np.int64)
                    if len(step) == len(place):
                        break
                hs.append(base + np.cumsum(step.astype(np.int64)))
                ds.append(ids[place >> 1])
                several.append((place & 1).astype(np.bool_))
        if hs:
            h, doc, more = np.concatenate(hs), np.concatenate(ds), np.concatenate(several)
            order = np.argsort(h, kind="stable")
            h, doc, more = h[order], doc[order], more[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            shared = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | np.logical_or.reduceat(more, first)
            stay = np.repeat(shared, np.diff(first, append=len(h)))
            out_h.append(h[stay])
            out_d.append(doc[stay])
        return pa.table({"doc_id": np.concatenate(out_d), "h": np.concatenate(out_h)})

    return packed.groupBy("bucket").applyInArrow(meet, "doc_id long, h long")


def _contexts(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h, c1, c2, doc_id, dh, at, n, bytes): every context of the anchors listed for its document.

    ``c1, c2`` are a 128-bit digest; ``bytes`` is null where the batch holds the context already.
    """

    def cut(batches):
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            ids, hashes, lists = batch.column(0), batch.column(1), batch.column(3)
            for lo, hi, raw, offsets in _text.blocks(batch.column(2)):
                first, last, h, doc = _anchors(raw, offsets, length, anchor)
                some = lists.slice(lo, hi - lo)
                sizes = np.diff(some.offsets.to_numpy())
                row_of = np.repeat(np.arange(hi - lo), sizes)
                wanted = some.flatten().to_numpy(zero_copy_only=False)
                tag = lambda row, x: _text.mix(x.astype(np.uint64) ^ (row.astype(np.uint64) << np.uint64(49)) ^ (row.astype(np.uint64) >> np.uint64(15)))
                pick = np.isin(tag(doc, h), tag(row_of, wanted))
                first, last, h, doc = first[pick], last[pick], h[pick], doc[pick]
                stop = last + length
                c1 = _text.span_hashes(_text.prefix_sums(raw), first, stop).view(np.int64)
                c2 = (_text.span_hashes(_text.prefix_sums(raw, other=True), first, stop) ^ _text.mix(h.astype(np.uint64))).view(np.int64)
                new = np.zeros(len(h), np.bool_)
                for i, key in enumerate(zip(c1.tolist(), c2.tolist())):
                    if key not in seen:
                        seen.add(key)
                        new[i] = True
                held = pa.nulls(len(h), pa.binary())
                if new.any():
                    where = np.where(new, np.cumsum(new) - 1, 0)
                    held = _text.slices(raw, first[new], stop[new]).take(pa.array(where, mask=~new))
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(c1), pa.array(c2), ids.take(rows), hashes.take(rows), pa.array((first - offsets[doc]).astype(np.int64)),
                     pa.array((last - first + 1).astype(np.int32)), held], names=["h", "c1", "c2", "doc_id", "dh", "at", "n", "bytes"])

    return texts.mapInArrow(cut, "h long, c1 long, c2 long, doc_id long, dh long, at long, n int, bytes binary")


def _sharing(values: pa.Array, least: np.ndarray, length: int) -> np.ndarray:
    """Rows of the contexts that have a window hash in common with another one, of another document.

    Most contexts meet by their anchor alone; they need no place in the index.  Equal windows have equal hashes,
    so none that shares a window is left out.
    """
    texts = values.to_pylist()
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts)
    h = _text.span_hashes(_text.prefix_sums(data), at, at + length)
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    both = np.minimum.reduceat(least[owner], first) < np.maximum.reduceat(least[owner], first)
    return np.unique(owner[np.repeat(both, np.diff(first, append=len(h)))])


def _marked(contexts: DataFrame, length: int) -> DataFrame:
    """(c1, c2, runs): windows of each context that a document smaller than its least one holds, as (first, last)."""
    from .rindex import RunLengthIndex

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    nothing = pa.table({"c1": pa.array([], pa.int64()), "c2": pa.array([], pa.int64()), "runs": pa.array([], kind)})

    def mark(table):
        table = table.sort_by([("least", "ascending")])
        table = table.take(pa.array(_sharing(table["bytes"].combine_chunks(), table["least"].to_numpy(), length)))
        if not table.num_rows:
            return nothing
        values = table["bytes"].combine_chunks().to_pylist()
        data, sizes = np.frombuffer(b"".join(values), np.uint8), np.array([len(x) for x in values], np.int64)
        ends, least, floor = np.cumsum(sizes), table["least"].to_numpy(), table["floor"].to_numpy()
        index = RunLengthIndex(data, ends, least, length)
        ask = np.flatnonzero(least > floor)  # others hold their anchor first
        inside = np.repeat(least > floor, sizes)
        owner = np.repeat(ask, sizes[ask])
        found = index.least_documents(data[inside], np.cumsum(sizes[ask]), np.iinfo(np.int64).max)
        flag = found < least[owner]
        runs: dict[int, list] = {}
        begin = np.cumsum(sizes[ask]) - sizes[ask]
        base = dict(zip(ask.tolist(), begin.tolist()))
        edge = np.concatenate(([True], (flag[1:] != flag[:-1]) | (owner[1:] != owner[:-1]))) if len(flag) else np.zeros(0, np.bool_)
        start = np.flatnonzero(edge)
        for a, b in zip(start.tolist(), np.append(start[1:], len(flag)).tolist() if len(start) else []):
            if flag[a]:
                o = int(owner[a])
                runs.setdefault(o, []).append({"a": a - base[o], "b": b - 1 - base[o]})
        rows = pa.array(list(runs), pa.int64())
        return pa.table({"c1": table["c1"].take(rows), "c2": table["c2"].take(rows),
                         "runs": pa.array(list(runs.values()), kind)})

    return contexts.groupBy("bucket").applyInArrow(mark, "c1 long, c2 long, runs array<struct<a:int,b:int>>")


def _marked_by_window(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many contexts for one index: single windows, counted by their content."""
    each = contexts.select("c1", "c2", "least", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - length)).alias("a"))
    each = each.select("c1", "c2", "least", "a", F.substring("bytes", F.col("a") + 1, F.lit(length)).alias("w"))
    first = each.groupBy("w").agg(F.min("least").alias("floor"))
    found = each.join(first, "w").where("floor < least")
    return found.groupBy("c1", "c2").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("a").cast("int").alias("b"))).alias("runs"))


def _slice_runs(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, dh, a, b): runs of windows to cut, by the contexts of one slice."""
    one = keep(found.groupBy("h", "c1", "c2").agg(F.min("doc_id").alias("least"), F.first("bytes", ignorenulls=True).alias("bytes")), "repeat-distinct")
    by_anchor = one.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("least").alias("floor"), F.max("least").alias("top")).where("m > 1 AND top > floor")
    mixed = keep(one.join(by_anchor.drop("top"), "h"), "repeat-mixed")
    size = mixed.agg(F.coalesce(F.sum(F.length("bytes").cast("long")), F.lit(0)).alias("b")).first().b
    bucket = F.pmod(F.xxhash64("h"), F.lit(max(1, -(-size // GROUP_BYTES)))).alias("bucket")
    marked = keep(_marked(mixed.where(F.col("m") <= HOT_CONTEXTS).select(bucket, "c1", "c2", "least", "floor", "bytes"), length).union(
        _marked_by_window(mixed.where(F.col("m") > HOT_CONTEXTS), length)), "repeat-verdicts")
    verdicts = one.select("c1", "c2", "least").join(marked, ["c1", "c2"], "left")
    judged = found.select("c1", "c2", "doc_id", "dh", "at", "n").join(verdicts, ["c1", "c2"])
    own = F.when(F.col("doc_id") > F.col("least"), F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b")))).otherwise(F.col("runs"))
    runs = keep(judged.select("doc_id", "dh", "at", F.explode(own).alias("r")).select(
        "doc_id", "dh", (F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b")).alias("b")), "repeat-runs")
    discard(one, mixed, marked)
    release(found.sparkSession)
    return runs


def marks(docs: DataFrame, length: int = 50, anchor: int = 16) -> DataFrame:
    """(doc_id, dh, whole, runs): windows to cut, as (first, last) start positions, of every document that has any.

    ``dh`` is the hash of the text and ``whole`` says that an equal text has a smaller id.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("dh"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.octet_length("text") >= length)
    digests = keep(rows.select("doc_id", "dh", F.unhex(F.sha2("text", 256)).alias("d"), F.octet_length("text").alias("bytes")), "repeat-digests")
    heads = digests.groupBy("d").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = keep(digests.join(heads, "d").where("doc_id > head").select("doc_id", "dh").distinct(), "repeat-copies")
    total = digests.agg(F.coalesce(F.sum(F.col("bytes").cast("long")), F.lit(0)).alias("b")).first().b
    groups = max(1, -(-total // (16 * GROUP_ANCHORS)))

    raw = keep(_shared_anchors(_packed(rows.select("doc_id", "text"), length, anchor, groups)), "repeat-anchors")
    release(spark)
    single = digests.join(copies, ["doc_id", "dh"], "left_anti").select("doc_id", "dh")
    left = raw.join(copies.select("doc_id").join(single, "doc_id", "left_anti").distinct(), "doc_id", "left_anti")
    still = left.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    shared = keep(left.join(still, "h", "left_semi"), "repeat-shared")
    lists = shared.groupBy("doc_id").agg(F.collect_list("h").alias("l")).join(single, "doc_id").select("doc_id", "dh", "l")
    found = _contexts(rows.join(lists, ["doc_id", "dh"]).select("doc_id", "dh", "text", "l"), length, anchor)
    found = keep(found.withColumn("slice", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(SLICES)).cast("int")), "repeat-contexts", slices="slice")
    discard(raw, shared)
    release(spark)
    parts = [_slice_runs(found.where(F.col("slice") == i).drop("slice"), length) for i in range(SLICES)]
    discard(found)
    runs = parts[0]
    for part in parts[1:]:
        runs = runs.union(part)
    runs = runs.groupBy("doc_id", "dh").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    out = keep(runs.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType)).withColumn("whole", F.lit(True))), "repeat-marks")
    release(spark)
    return out


def remove_repeats(docs: DataFrame, length: int = 50, anchor: int = 16) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for every row of ``docs``.

    ``spans`` are the maximal removed byte runs, ``kept`` the remaining bytes (a cut may fall inside a
    character).  A null text is empty; texts under ``length`` bytes have nothing to lose; rows with a null id
    lose nothing and are no source; rows equal in id and text are one document.  Other columns are ignored.
    """
    if not 29 <= length <= 50 or not 1 <= anchor <= length:
        raise ValueError("length must be from 29 to 50, anchor at most length")
    found = marks(docs, length, anchor).select(F.col("doc_id").alias("__id"), F.col("dh").alias("__h"), "whole", "runs")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = rows.join(found, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__h")), "left").select("doc_id", "text", "whole", "runs")

    def cut(batches):
        for batch in batches:
            whole, runs = batch.column(2), batch.column(3)
            for lo, hi, raw, offsets in _text.blocks(batch.column(1)):
                gone = np.zeros(len(raw), np.bool_)
                for row in range(lo, hi):
                    a, b = offsets[row - lo], offsets[row - lo + 1]
                    if whole[row].as_py():
                        gone[a:b] = True
                    elif runs[row].is_valid:
                        s = runs.slice(row, 1).flatten()
                        edge = np.zeros(b - a + 1, np.int32)
                        np.add.at(edge, s.field(0).to_numpy(), 1)
                        np.add.at(edge, s.field(1).to_numpy() + length, -1)
                        gone[a:b] = np.cumsum(edge[:-1]) > 0
                stay = np.concatenate(([0], np.cumsum(~gone)))
                spans = []
                for row in range(lo, hi):
                    a, b = offsets[row - lo], offsets[row - lo + 1]
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(*_text.runs(gone[a:b]))] if stay[b] - stay[a] < b - a else [])
                kept = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(stay[offsets].astype(np.int32)), pa.py_buffer(raw[~gone])])
                sizes = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(sizes - np.diff(stay[offsets])),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), kept],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary")
