"""Best-fit packing by the linear grouping scheme.

Documents are tokenised, closed with an end id and, only where longer than a sequence, cut into whole sequences after a
first piece with the rest.  Pieces of more than a quarter of a sequence are large.  The histogram of all lengths (one
number for each length, whatever the corpus) gives groups of equal cardinality; every large length is rounded up to the
longest of its group, and column generation finds the fractional optimum over configurations of these few sizes.

Pieces are then dealt into randomised groups.  Each one takes the configurations in proportion, substitutes its own
pieces for the rounded lengths (the last slot of a sequence takes the longest piece that its real room allows, so
rounding leaves next to no gap), and packs what is left, small pieces above all, by best fit.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep
from .packing import encoder

#: A piece is large above this share of a sequence, so a configuration holds three at most.
LARGE_SHARE = 4


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, length: int, with_ids: bool) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]); a null or empty text has only the end id."""

    def pieces(batches):
        encode, end = encoder(tokenizer_path).encode, np.array([end_id], "<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(pc.fill_null(part.column(1), "").to_pylist())):
                    ids = np.concatenate((ids, end))
                    first = len(ids) % length or length
                    borders = [0, *range(first, len(ids) + 1, length)]
                    for i, (a, b) in enumerate(zip(borders, borders[1:])):
                        rows.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b]), ids[a:b]))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, schema)


def equal_groups(counts: np.ndarray, least: int, groups: int) -> np.ndarray:
    """Sizes, falling, to which lengths of ``least`` and more round up: each the longest of an equal share of them."""
    lengths = np.arange(len(counts))[least:][::-1]
    below = np.cumsum(counts[least:][::-1])
    if not len(below) or not below[-1]:
        return np.zeros(0, np.int64)
    before = below - counts[least:][::-1]
    starts = np.unique((np.minimum(np.arange(groups), below[-1]) * below[-1]) // groups)
    sizes = lengths[np.searchsorted(below, starts, side="right")]
    return np.unique(sizes[before[len(counts) - 1 - sizes] < below[-1]])[::-1].astype(np.int64)


def _best_column(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of the highest price, by one round of dynamic programming for each further piece."""
    best, choices = np.zeros(capacity + 1), []
    while True:
        following, choice = best.copy(), np.full(capacity + 1, -1)
        for i, (size, price) in enumerate(zip(sizes.tolist(), prices.tolist())):
            value = best[:capacity + 1 - size] + price
            better = value > following[size:] + 1e-12
            following[size:][better] = value[better]
            choice[size:][better] = i
        if (choice < 0).all():
            break
        best = following
        choices.append(choice)
    column, room = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            column[choice[room]] += 1
            room -= sizes[choice[room]]
    return column, float(best[capacity])


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(configurations x sizes, how often each is used): the linear optimum by column generation, to a relative ``gap``."""
    k = len(sizes)
    if not k:
        return np.zeros((0, 0), np.int64), np.zeros(0)
    basis = np.diag((capacity // sizes).astype(float))
    demand = demand * (1 + 1e-7 * np.arange(1, k + 1))  # no two equal: the simplex method does not circle
    used = demand / np.diag(basis)
    while True:
        column, value = _best_column(sizes, np.linalg.solve(basis.T, np.ones(k)), capacity)
        if value <= 1 + gap:
            return basis.T.astype(np.int64), used
        direction = np.linalg.solve(basis, column)
        ratio = np.where(direction > 1e-10, used / np.where(direction > 1e-10, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        used = np.maximum(used - step * direction, 0)
        used[out] = step
        basis[:, out] = column


@dataclass
class Plan:
    """Rounded sizes with the least length of each, configurations and how many of each a piece of the corpus stands for."""

    length: int
    sizes: np.ndarray
    borders: np.ndarray
    configs: np.ndarray
    shares: np.ndarray


def make_plan(counts: np.ndarray, length: int, groups: int) -> Plan:
    """The plan of a histogram of lengths (index: length); whole sequences need none."""
    some = counts.copy()
    some[length] = 0
    least = length // LARGE_SHARE + 1
    sizes = equal_groups(some, least, groups)
    borders = np.append(sizes[1:] + 1, least) if len(sizes) else sizes
    demand = np.array([some[a:b + 1].sum() for a, b in zip(borders, sizes)], float)
    configs, used = configurations(sizes, demand, length)
    order = np.argsort(-(configs @ sizes), kind="stable") if len(sizes) else []
    return Plan(length, sizes, borders, configs[order], used[order] / max(int(counts.sum()), 1))


class _Stock:
    """Pieces by length; one bit for each length at hand finds the longest one in a range without a search."""

    def __init__(self, sizes: np.ndarray, length: int):
        self.of: list[list[int]] = [[] for _ in range(length + 1)]
        for i, size in enumerate(sizes.tolist()):
            self.of[size].append(i)
        self.lengths = sum(1 << n for n, some in enumerate(self.of) if some)

    def longest(self, room: int) -> int:
        """The longest length of at most ``room``, -1 without any."""
        return (self.lengths & ((2 << room) - 1)).bit_length() - 1

    def take(self, size: int) -> int:
        piece = self.of[size].pop()
        if not self.of[size]:
            self.lengths ^= 1 << size
        return piece

    def give(self, size: int, piece: int) -> None:
        self.of[size].append(piece)
        self.lengths |= 1 << size


def _substitute(plan: Plan, stock: _Stock, n: int) -> list[list[int]]:
    """Sequences of pieces, by configurations in proportion to ``n`` pieces of the group.

    Slots take the longest pieces of their size group.  The last one has the room that rounding left in the others
    as well, and takes the longest piece that fits.
    """
    out: list[list[int]] = []
    for config, share in zip(plan.configs, plan.shares):
        slots = np.repeat(np.arange(len(config)), config).tolist()
        for _ in range(int(share * n)):
            room, taken = plan.length, []
            for slot in slots:
                last = len(taken) == len(slots) - 1
                size = stock.longest(room if last else int(plan.sizes[slot]))
                if size < plan.borders[slot]:
                    break
                taken.append((size, stock.take(size)))
                room -= size
            if len(taken) < len(slots):  # a size group has run out: the configuration is given up
                for size, piece in taken:
                    stock.give(size, piece)
                break
            out.append([piece for _, piece in taken])
    return out


def best_fit(sizes: list[int], free: list[int], length: int) -> list[int]:
    """Bin of every size (in the given order): the fullest open bin with room, else a new one; extends ``free``.

    One bit for each amount of room that some bin has finds the best fit without a search.
    """
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, out = 0, []
    for b, room in enumerate(free):
        by_room[room].append(b)
        rooms |= 1 << room
    for size in sizes:
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(free), length
            free.append(length)
        room -= size
        free[b] = room
        by_room[room].append(b)
        rooms |= 1 << room
        out.append(b)
    return out


def pack_group(sizes: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece of one group."""
    bins = np.full(len(sizes), -1, np.int64)
    whole = np.flatnonzero(sizes == plan.length)
    bins[whole] = np.arange(len(whole))
    part = np.flatnonzero(sizes < plan.length)
    filled = _substitute(plan, _Stock(sizes[part], plan.length), len(sizes))
    for b, taken in enumerate(filled, len(whole)):
        bins[part[taken]] = b
    free = np.full(len(whole) + len(filled), plan.length, np.int64)
    done = bins >= 0
    np.subtract.at(free, bins[done], sizes[done])
    rest = np.flatnonzero(~done)
    rest = rest[np.argsort(-sizes[rest], kind="stable")]
    bins[rest] = best_fit(sizes[rest].tolist(), free.tolist(), plan.length)
    by_bin = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[by_bin])
    starts = ends - sizes[by_bin]
    first = np.append(True, np.diff(bins[by_bin]) > 0)[:len(bins)]
    offsets = np.zeros(len(sizes), np.int64)
    offsets[by_bin] = starts - np.maximum.accumulate(np.where(first, starts, 0)) if len(bins) else 0
    return bins, offsets


def pack(pieces: DataFrame, length: int = 2048, size_groups: int = 64, group_pieces: int = 32_768, seed: int = 5) -> DataFrame:
    """Add ``sequence_id`` (group in the high half) and ``offset`` to pieces of at most ``length``."""
    pieces = keep(pieces, "grouping-pieces")
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("c")).collect()  # at most ``length`` rows
    counts = np.zeros(length + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["c"]
    plan, groups = make_plan(counts, length, size_groups), max(1, -(-int(counts.sum()) // group_pieces))
    columns = pieces.columns
    dealt = pieces.withColumn("__row", F.monotonically_increasing_id())  # repeated rows part as well
    dealt = dealt.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "__row"), F.lit(groups))).drop("__row")

    def place(key, table):
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]))
        sizes = table["length"].to_numpy().astype(np.int64)
        bins, offsets = pack_group(sizes, plan)
        out = table.select(columns).append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins, pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("__group").applyInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = 2048, size_groups: int = 64,
                   group_pieces: int = 32_768, seed: int = 5, with_ids: bool = True) -> DataFrame:
    """Packed pieces of all documents; with ``with_ids`` each carries its ids, without only their checksum.

    A document of at most ``length`` ids stays whole.  Null and empty texts are packed with their end id alone,
    repeated rows and null ids each; no documents give no rows; other columns are ignored.
    """
    return pack(cut(docs, tokenizer_path, end_id, length, with_ids), length, size_groups, group_pieces, seed)
