"""Near-duplicates by MinHash with tensored banding, every link confirmed on full shingle sets.

Two small collections of ``halves`` bands are computed, each band over ``rows`` minhashes.  Table keys are all
pairs of a band of the first and a band of the second collection: ``halves ** 2`` keys of ``2 * rows`` minhashes
from ``2 * halves * rows`` of them, about a square root of what plain banding computes for as many tables.  A
pair of similarity s shares a key unless one collection has no common band: 1 - (1 - (1 - s**rows)**halves)**2,
0.006 % at 0.85 with the defaults.  Only bands that two documents share are paired, so most documents emit none.

Documents with equal sets are one class.  Before keys are made, every class is compared with the pivot with which it
shares most bands, for as long as that links many; bands that lie in one component then need no keys.  Buckets of the
tables are not expanded into pairs: their members are mostly near, but not near enough, so pairs of them are compared
only if their rarest shingles and the parity sketches of their sets leave a link possible.  Both bounds are exact, and
both are conditions of one join, so pairs that are near but not near enough never become rows.  Nothing is capped.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_lookup
from . import _text
from ._shared import keep
from .components import components

#: Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = np.ones(256, np.bool_)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bits of a sketch (a multiple of 64): longer ones part larger sets.
SKETCH_BITS = 1024

#: Bands two classes must share to be compared before the tables are made; those with fewer meet there.
CLOSE_BANDS = 8


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(97).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int):
    """Distinct shingle hashes of all texts, concatenated, and the number of each text."""
    data = _text.LOWER[raw]
    starts, ends, doc = _text.tokens(WORD, data, offsets)
    h = _text.span_hashes(_text.prefix_sums(data), starts, ends)
    texts = len(offsets) - 1
    words = np.bincount(doc, minlength=texts)
    first = np.cumsum(words) - words
    w = _text.window_hashes(h, width)
    sets, counts = [], np.zeros(texts, np.int64)
    for i in range(texts):
        a, n = first[i], words[i]
        if n >= width:
            s = np.sort(w[a:a + n - width + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            s = _text.window_hashes(h[a:a + n], int(n))
        else:
            continue
        sets.append(s)
        counts[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def shingles(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, shingles): the set of every text as sorted 64-bit hashes; empty without words."""

    def cut(batches):
        for batch in batches:
            for lo, hi, raw, offsets in _text.blocks(batch.column(1)):
                values, counts = _shingle_sets(raw, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), _text.list_array(values.view(np.int64), counts, pa.int64())], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, shingles array<long>")


def signatures(docs: DataFrame, width: int, halves: int, rows: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands): set size, a 128-bit digest of the set and the bands of both collections."""

    def sign(batches):
        factors = _multipliers(2 * halves * rows)
        for batch in batches:
            for lo, hi, raw, offsets in _text.blocks(batch.column(1)):
                values, counts = _shingle_sets(raw, offsets, width)
                full = np.flatnonzero(counts)
                at = (np.cumsum(counts) - counts)[full]
                d = np.zeros((2, hi - lo), np.uint64)
                bands = np.zeros((len(full), 2 * halves), np.uint64)
                if len(full):
                    d[0, full] = np.add.reduceat(_text.mix(values), at)
                    d[1, full] = np.add.reduceat(_text.mix(values ^ np.uint64(0xA0761D6478BD642F)), at)
                    for k, factor in enumerate(factors):
                        low = np.minimum.reduceat(values * factor, at)
                        bands[:, k // rows] = _text.mix(bands[:, k // rows] * np.uint64(3) + low + np.uint64(k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)),
                     _text.list_array(bands.reshape(-1).view(np.int64), np.where(counts > 0, 2 * halves, 0), pa.int64())],
                    names=["doc_id", "n", "d1", "d2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sign, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def shared_bands(classes: DataFrame) -> DataFrame:
    """(doc, n, place, band, degree): the bands that two classes or more have.

    ``degree`` is high for classes that share bands with many others, which makes good pivots.
    """
    each = classes.select("doc", "n", F.posexplode("bands").alias("place", "band"))
    shared = each.groupBy("place", "band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = keep(each.join(shared, ["place", "band"]), "minhash-bands")
    return rows.drop("c").join(rows.groupBy("doc").agg(F.sum("c").alias("degree")), "doc")


def _pivot_pairs(bands: DataFrame, lists: DataFrame, met: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (p, x): every class with that pivot of its bands with which it shares most bands, ``CLOSE_BANDS`` at least.

    A band's pivot is its member of the highest degree, in later turns one of a hash of its own for each turn, which
    the bands of a group agree on.  Pairs that have met, or lie in one component, do not meet.
    """
    first = F.col("degree") if turn == 0 else F.xxhash64("doc", F.lit(turn))
    pivots = bands.groupBy("place", "band").agg(F.max(F.struct(first.alias("first"), "doc", "label")).alias("q"))
    near = bands.join(pivots, ["place", "band"]).where(F.col("label") != F.col("q.label")).select(F.col("doc").alias("x"), F.col("q.doc").alias("p")).distinct()
    if met is not None:
        near = near.join(met, ["x", "p"], "left_anti")
    near = near.join(lists.select(F.col("doc").alias("x"), F.col("l").alias("lx")), "x").join(lists.select(F.col("doc").alias("p"), F.col("l").alias("lp")), "p")
    near = near.withColumn("c", F.size(F.array_intersect("lx", "lp"))).where(F.col("c") >= CLOSE_BANDS)
    best = near.groupBy("x").agg(F.max(F.struct("c", "p")).alias("best"))
    return keep(best.select(F.col("best.p").alias("p"), "x"), "minhash-met")


def contract(bands: DataFrame, docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Join the members of groups of near copies before any table key is made: (open bands with labels, links, labels).

    In each round a class is compared with one pivot, so a round makes at most a pair for each class, however many
    bands a group of near copies shares.  Bands whose members all lie in one component are closed: no key of theirs
    can find a further link between components.  This only finds confirmed links earlier; what is still open goes to
    the tables, so nothing depends on the number of rounds.
    """
    state, links, labels, met, turn = keep(bands.withColumn("label", F.col("doc")), "minhash-bands"), None, None, None, 0
    lists = keep(bands.groupBy("doc").agg(F.collect_list(F.struct("place", "band")).alias("l")), "minhash-lists")
    while True:
        pairs = _pivot_pairs(state, lists, met, turn)
        met = pairs if met is None else met.union(pairs.select(*met.columns))
        ends = keep(pairs.select(F.explode(F.array("p", "x")).alias("doc_id")).distinct(), "minhash-ends")
        found = keep(_confirmed(pairs, sets_of(docs, ends, width), percent), "minhash-links")
        tried, new = pairs.count(), found.count()
        if new:
            links = found if links is None else links.union(found)
            labels = components(links)
            state = state.drop("label").join(labels.select(F.col("v").alias("doc"), F.col("root").alias("label")), "doc", "left")
            state = state.withColumn("label", F.coalesce("label", "doc"))
            spread = state.groupBy("place", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("place", "band")
            state = keep(state.join(spread, ["place", "band"], "left_semi"), "minhash-bands")
        if 8 * new <= tried:
            return state, links, labels
        turn += 1


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Shingle sets of the documents with the given ids; the texts stay in place while the ids are a small table."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keep(shingles(join_lookup(own, ids, "doc_id", "left_semi"), width), "minhash-sets")


def bucket_rows(bands: DataFrame, halves: int) -> DataFrame:
    """(key, doc, n, label): members of all table buckets that hold two components or more."""
    kept = bands.groupBy("doc", "n", "label").agg(F.collect_list(F.struct("place", "band")).alias("l"))
    half = lambda test: F.transform(F.filter("l", lambda x: test(x["place"])), lambda x: x["band"])
    keys = kept.select("doc", "n", "label", half(lambda p: p < halves).alias("a"), half(lambda p: p >= halves).alias("b"))
    rows = keys.withColumn("x", F.explode("a")).select("doc", "n", "label", "b", "x").withColumn("y", F.explode("b"))
    rows = keep(rows.select(F.xxhash64("x", "y").alias("key"), "doc", "n", "label"), "minhash-keys")
    full = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return keep(rows.join(full, "key", "left_semi"), "minhash-rows")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, x) with 100 * intersection >= percent * union on their full sets."""
    left = sets.select(F.col("doc_id").alias("p"), F.col("shingles").alias("sp"))
    right = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("sx"))
    both = pairs.join(right, "x").join(left, "p").withColumn("same", F.size(F.array_intersect("sp", "sx")).cast("long"))
    return both.where(100 * F.col("same") >= percent * (F.size("sp") + F.size("sx") - F.col("same"))).select(
        F.least("p", "x").alias("a"), F.greatest("p", "x").alias("b")).distinct()


def sketches(sets: DataFrame) -> DataFrame:
    """(doc, sketch): every bit tells whether an odd number of the set's shingles falls on it.

    A shingle that two sets share changes both sketches alike, so two sketches never differ in more bits than there
    are shingles in only one of the sets.
    """

    def fold(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                lists = batch.column(1).slice(lo, 1024)
                rows = len(lists)
                bits = (_text.mix(lists.flatten().to_numpy().view(np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
                place = np.repeat(np.arange(rows), lists.value_lengths().to_numpy(zero_copy_only=False)) * SKETCH_BITS + bits
                odd = (np.bincount(place, minlength=rows * SKETCH_BITS) & 1).astype(np.uint8)
                words = np.packbits(odd).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), _text.list_array(words, np.full(rows, SKETCH_BITS // 64), pa.int64())], names=["doc", "sketch"])

    return sets.select("doc_id", "shingles").mapInArrow(fold, "doc long, sketch array<long>")


def _differing(a: str, b: str) -> Column:
    """The number of bits in which two sketches differ."""
    return reduce(add, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64)])


def _prefix_pairs(active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, x) of members of unfinished buckets that can be linked, by their rarest shingles.

    With shingles in one order, rarest first, linked sets share one among the first ``n - needed + 1`` of each,
    and the places of the first common one bound the intersection.  Linked sets of n and m shingles have at most
    ``(100 - percent) * (n + m) / (100 + percent)`` in only one of them, and their sketches differ in no more bits.
    Exact, and not limited to a bucket.
    """
    least = active.groupBy("key").agg(F.min("n").alias("least"))
    each = active.join(least, "key").groupBy("doc").agg(F.max("n").alias("n"), F.max("label").alias("label"), F.min("least").alias("least"))
    each = keep(each.withColumn("least", F.greatest("least", F.ceil(F.col("n") * percent / 100))), "minhash-open")
    words = sets.join(each.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), F.explode("shingles").alias("s"))
    counts = words.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    sorted_sets = words.join(counts, "s").groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("c", "s"))).alias("l")).join(each, "doc")
    needed = F.ceil(percent * (F.col("n") + F.col("least")) / F.lit(100 + percent))
    prefix = sorted_sets.select("doc", "n", "label", F.posexplode(F.slice("l", F.lit(1), F.greatest(F.lit(0), F.col("n") - needed + 1).cast("int"))).alias("at", "w"))
    prefix = prefix.where("w.c > 1").select("doc", "n", "label", (F.col("n") - F.col("at")).alias("left"), F.col("w.s").alias("s"))
    prefix = keep(prefix.join(sketches(sets), "doc"), "minhash-prefix")
    other = prefix.select("s", *[F.col(c).alias(f"o_{c}") for c in ("doc", "n", "label", "left", "sketch")])
    return prefix.join(other, "s").where(
        (F.col("doc") < F.col("o_doc")) & (F.col("label") != F.col("o_label"))
        & ((100 + percent) * F.least("left", "o_left") >= percent * (F.col("n") + F.col("o_n")))
        & ((100 + percent) * _differing("sketch", "o_sketch") <= (100 - percent) * (F.col("n") + F.col("o_n")))).select(
        F.col("doc").alias("p"), F.col("o_doc").alias("x")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85, halves: int = 11, rows: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked at ``percent`` of 100 similarity or more; a component is named by its smallest id, and
    that document is kept.  Texts without words, null texts and null ids are linked with nothing and kept.
    Repeated rows share their class and are judged alike; an id with several texts is linked by any of them.
    Other columns are ignored.
    """
    signed = keep(signatures(docs, width, halves, rows), "minhash-signatures")
    classes = keep(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(
        F.min(F.struct("doc_id", "bands")).alias("s")).select("d1", "d2", "n", F.col("s.doc_id").alias("doc"), F.col("s.bands").alias("bands")), "minhash-classes")
    bands, links, labels = contract(shared_bands(classes), docs, width, percent)
    rows = bucket_rows(bands, halves)
    sets = sets_of(docs, keep(rows.select(F.col("doc").alias("doc_id")).distinct(), "minhash-open"), width)
    found = keep(_confirmed(keep(_prefix_pairs(rows, sets, percent), "minhash-pairs"), sets, percent), "minhash-links")
    roots = labels if found.isEmpty() else components(found if links is None else links.union(found))
    named = classes.select("d1", "d2", "n", F.col("doc").alias("root")) if roots is None else classes.join(
        roots.select(F.col("v").alias("doc"), "root"), "doc", "left").select("d1", "d2", "n", F.coalesce("root", "doc").alias("root"))
    return signed.join(named, ["d1", "d2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (all columns) with one document of each group of near-duplicates."""
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
