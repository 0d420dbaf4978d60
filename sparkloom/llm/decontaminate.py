"""Benchmark decontamination: windows of benchmark words looked up in every training text.

A Spark job spells the windows of all items and measures them.  While they are below ``part_bytes`` their hashes are
broadcast, and a hash that is found is verified word by word where the text is.  A larger set of windows never
reaches the driver or a worker whole: a bitmap of fixed size stands in for it, the windows of texts that pass the
bitmap are joined with the benchmark's by their words, and the hits come back to the texts.  Both give the same rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import fresh, keep

#: Word bytes after A-Z are lower-cased: 0-9, a-z and every byte of a character beyond ASCII.
WORD = np.zeros(256, np.bool_)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

_FILTER_BITS = 22
#: The bitmap of the join has 2 ** 20 words of 64 bits, whatever the size of the benchmark.
_BITMAP_WORDS = 20
#: Parts of the rows of a window in the join: a passage that very many documents hold is dealt over as many tasks.
_SALTS = 16


def _words(raw: np.ndarray, offsets: np.ndarray):
    data = _text.LOWER[raw]
    starts, ends, doc = _text.tokens(WORD, data, offsets)
    return data, starts, ends, doc, _text.span_hashes(_text.prefix_sums(data), starts, ends)


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(n, words, h, items): every distinct window of n words, spelled, with its hash and the ids of its items."""

    def spell(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, raw, offsets in _text.blocks(batch.column(1)):
                data, starts, ends, doc, h = _words(raw, offsets)
                words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
                rows = []
                for i in range(hi - lo):
                    a, b = np.searchsorted(doc, [i, i + 1])
                    n = min(width, b - a)
                    if n:
                        keys = _text.window_hashes(h[a:b], int(n)).view(np.int64).tolist()
                        rows += [(n, b" ".join(words[a + k:a + k + n]), key, names[lo + i]) for k, key in enumerate(keys)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(
                        zip(*rows), (pa.int32(), pa.binary(), pa.int64(), pa.string()))], names=["n", "words", "h", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    each = rows.mapInArrow(spell, "n int, words binary, h long, item string")
    return each.groupBy("n", "words").agg(F.first("h").alias("h"), F.sort_array(F.collect_set("item")).alias("items"))


class WindowSet:
    """Windows of benchmark items: hash to (words, items)."""

    def __init__(self, rows):
        self.windows: dict[int, dict[int, list[tuple[bytes, list[str]]]]] = {}
        for row in rows:
            self.windows.setdefault(row.n, {}).setdefault(row.h % (1 << 64), []).append((bytes(row.words), list(row["items"])))

    def arrays(self) -> list[tuple[int, np.ndarray, np.ndarray, dict]]:
        out = []
        for n, windows in sorted(self.windows.items()):
            keys = np.sort(np.fromiter(windows, np.uint64, len(windows)))
            seen = np.zeros(1 << _FILTER_BITS, np.bool_)
            seen[keys >> np.uint64(64 - _FILTER_BITS)] = True
            out.append((n, keys, seen, windows))
        return out


def _scan_block(data, starts, ends, doc, h, tables):
    """Per window found: (first word, end word, item names)."""
    for n, keys, seen, windows in tables:
        w = _text.window_hashes(h, n)
        if not len(w):
            continue
        at = np.flatnonzero(seen[w >> np.uint64(64 - _FILTER_BITS)] & (doc[:len(w)] == doc[n - 1:]))
        if not len(at):
            continue
        place = np.minimum(np.searchsorted(keys, w[at]), len(keys) - 1)
        for i in at[keys[place] == w[at]].tolist():
            spelled = b" ".join([data[a:b].tobytes() for a, b in zip(starts[i:i + n], ends[i:i + n])])
            for known, names in windows[int(w[i])]:
                if known == spelled:
                    yield i, i + n, names


def _lookup(benchmark: DataFrame, width: int, part_bytes: int):
    """(windows, broadcast window set, or None where it would be over ``part_bytes``)."""
    spelled = keep(windows(benchmark, width), "decontaminate-windows")
    size = spelled.agg(F.sum(F.octet_length("words") + 64 + F.aggregate("items", F.lit(0), lambda a, x: a + 16 + F.octet_length(x)))).first()[0] or 0
    if size > part_bytes:
        return spelled, None
    return spelled, benchmark.sparkSession.sparkContext.broadcast(WindowSet(spelled.collect()))


def _bitmap(spelled: DataFrame) -> np.ndarray:
    """A bit for the leading bits of every window hash; 8 MB at any size of the benchmark."""
    place = F.shiftrightunsigned("h", 64 - _BITMAP_WORDS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - _BITMAP_WORDS - 6}) & 63 AS int))")
    rows = spelled.groupBy(place.alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << _BITMAP_WORDS, np.uint64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _hits(texts: DataFrame, row: str, spelled: DataFrame) -> DataFrame:
    """(row, n_words, hit_words, items) of every text, through a join of its windows that pass the bitmap."""
    sizes = sorted(r.n for r in spelled.select("n").distinct().collect())
    held = texts.sparkSession.sparkContext.broadcast(_bitmap(spelled))

    def candidates(batches):
        bitmap = held.value
        for batch in batches:
            for lo, hi, raw, offsets in _text.blocks(batch.column(1)):
                data, starts, ends, doc, h = _words(raw, offsets)
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                counts = np.bincount(doc, minlength=hi - lo)
                first = np.cumsum(counts) - counts
                for n in sizes:
                    w = _text.window_hashes(h, n)
                    bits = bitmap[(w >> np.uint64(64 - _BITMAP_WORDS)).astype(np.int64)] >> ((w >> np.uint64(58 - _BITMAP_WORDS)) & np.uint64(63))
                    for i in np.flatnonzero((bits & np.uint64(1)).astype(bool) & (doc[:len(w)] == doc[n - 1:])).tolist():
                        spell = b" ".join([data[a:b].tobytes() for a, b in zip(starts[i:i + n], ends[i:i + n])])
                        found[doc[i]].append({"n": n, "at": i - int(first[doc[i]]), "words": spell})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()),
                     pa.array(found, pa.list_(pa.struct([("n", pa.int32()), ("at", pa.int32()), ("words", pa.binary())])))],
                    names=["row", "n_words", "found"])

    seen = keep(texts.select(F.col(row).alias("row"), F.col("text").cast("string")).mapInArrow(
        candidates, "row long, n_words long, found array<struct<n:int,at:int,words:binary>>"), "decontaminate-candidates")
    each = seen.select("row", F.inline("found")).withColumn("salt", F.pmod("row", F.lit(_SALTS)))
    copies = spelled.select("n", "words", "items", F.explode(F.expr(f"sequence(0L, {_SALTS - 1}L)")).alias("salt"))
    hits = each.join(copies, ["n", "words", "salt"]).groupBy("row").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))))).alias("hit_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return seen.select("row", "n_words").join(hits, "row", "left").select(
        "row", "n_words", F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


FOUND = "n_words long, hit_words array<int>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, part_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_words, hit_words, items) for every row of ``docs``.

    ``hit_words`` are the positions of all words inside an occurrence of a window, ``items`` the sorted ids of
    the items with such windows.  A null or empty text has no words; repeated rows are judged each; items
    without text, words or id have no windows; other columns are ignored.  Windows of more than ``part_bytes`` are
    joined, fewer are broadcast.
    """
    spelled, held = _lookup(benchmark, width, part_bytes)
    if held is None:
        texts = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
            "row", F.monotonically_increasing_id()), "decontaminate-texts")
        return texts.select("row", "doc_id").join(_hits(texts, "row", spelled), "row").drop("row")

    def find(batches):
        tables = held.value.arrays()
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi, raw, offsets in _text.blocks(column):
                data, starts, ends, doc, h = _words(raw, offsets)
                hit = np.zeros(len(starts), np.bool_)
                items: list[set[str]] = [set() for _ in range(hi - lo)]
                for a, b, names in _scan_block(data, starts, ends, doc, h, tables):
                    hit[a:b] = True
                    items[doc[a]].update(names)
                counts = np.bincount(doc, minlength=hi - lo)
                first = np.cumsum(counts) - counts
                at = np.flatnonzero(hit)
                where = doc[at]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(counts, pa.int64()),
                     _text.list_array((at - first[where]).astype(np.int32), np.bincount(where, minlength=hi - lo), pa.int32()),
                     pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "hit_words", "items"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, f"doc_id long, {FOUND}")


def _without(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The bytes without the hit words and all that stands between neighbouring ones."""
    stay = np.ones(len(raw), np.bool_)
    for a, b in zip(*_text.runs(hit)):
        stay[starts[a]:ends[b - 1]] = False
    return raw[stay]


def _clean(text: str, tables) -> str:
    """Cut hit words out, with all that stands between them, until no window is left."""
    raw = np.frombuffer(text.encode(), np.uint8)
    while True:
        data, starts, ends, doc, h = _words(raw, np.array([0, len(raw)]))
        hit = np.zeros(len(starts), np.bool_)
        for a, b, _ in _scan_block(data, starts, ends, doc, h, tables):
            hit[a:b] = True
        if not hit.any():
            return raw.tobytes().decode()
        raw = _without(raw, starts, ends, hit)


def _has_words(raw: np.ndarray) -> bool:
    return bool(WORD[_text.LOWER[raw]].any())


def _remove_joined(docs: DataFrame, spelled: DataFrame, how: str) -> DataFrame:
    """``remove`` through the join: rows that were cut are looked up again until none is hit."""
    names = docs.columns
    row, mark = fresh(docs, "row", "hit_words")
    place, width = names.index("text"), len(names)
    open_rows, clean = keep(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows"), []

    def cut(batches):
        for batch in batches:
            texts = []
            for text, hits in zip(batch.column(place).to_pylist(), batch.column(width + 1).to_pylist()):
                raw = np.frombuffer(text.encode(), np.uint8)
                _, starts, ends, _, _ = _words(raw, np.array([0, len(raw)]))
                hit = np.zeros(len(starts), np.bool_)
                hit[hits] = True
                texts.append(_without(raw, starts, ends, hit).tobytes().decode())
            arrays = list(batch.columns)[:width + 1]
            arrays[place] = pa.array(texts, arrays[place].type)
            stay = [_has_words(np.frombuffer(x.encode(), np.uint8)) for x in texts]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, row]).filter(pa.array(stay, pa.bool_()))

    while True:
        hits = keep(_hits(open_rows, row, spelled).where(F.size("hit_words") > 0).select(F.col("row").alias(row), F.col("hit_words").alias(mark)), "decontaminate-hits")
        clean.append(open_rows.join(hits.select(row), row, "left_anti").select(*names))
        if how == "documents" or hits.isEmpty():
            return reduce(DataFrame.union, clean)
        open_rows = keep(open_rows.join(hits, row).select(*names, row, mark).mapInArrow(cut, open_rows.select(*names, row).schema), "decontaminate-rows")


def remove(docs: DataFrame, benchmark: DataFrame, how: str = "spans", width: int = 10, part_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` (all columns) without benchmark passages.

    ``how="spans"`` cuts the hit words out and scans again until nothing is left to find, ``"documents"`` drops
    every document with a hit.  Rows whose text was null or clean stay as they are; a document of which no word
    is left after cutting is dropped.
    """
    if how not in ("spans", "documents"):
        raise ValueError("how must be spans or documents")
    spelled, held = _lookup(benchmark, width, part_bytes)
    if held is None:
        return _remove_joined(docs, spelled, how)
    place = docs.columns.index("text")

    def clean(batches):
        tables = held.value.arrays()
        for batch in batches:
            column = batch.column(place)
            changed: dict[int, str] = {}
            for lo, _, raw, offsets in _text.blocks(column):
                data, starts, ends, doc, h = _words(raw, offsets)
                for row in {int(doc[a]) for a, _, _ in _scan_block(data, starts, ends, doc, h, tables)}:
                    changed[lo + row] = ""
            if not changed:
                yield batch
                continue
            if how == "spans":
                for row in changed:
                    changed[row] = _clean(column[row].as_py(), tables)
            texts = column.to_pylist()
            stay = np.ones(batch.num_rows, np.bool_)
            for row, text in changed.items():
                texts[row] = text
                stay[row] = _has_words(np.frombuffer(text.encode(), np.uint8))
            arrays = list(batch.columns)
            arrays[place] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(stay))

    return docs.mapInArrow(clean, docs.schema)


