"""Packing of token ids into sequences: first-fit decreasing over a tournament tree, in randomised groups.

Each document is tokenised, closed with an end id and cut into pieces of at most the sequence length.  Pieces
are dealt into groups by a hash of (document, start); every group is packed on its own by first-fit decreasing,
where a tournament tree over the free space of the bins finds the first bin that fits in logarithmic time.
Groups hold about ``group_pieces`` pieces at every corpus size, and one long document spreads over all groups.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep

_ODD_SPACE = re.compile(r" (?:\s|\Z)")



#: Fixed value: the published word pattern of byte-level pre-tokenizers.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    return ChunkEncoder(path)


class ChunkEncoder:
    """Ids of whole texts, by the tokenizer's own encoding of each distinct space-led chunk.

    A byte-level pre-tokenizer always starts a new word at a space that a non-space follows, so a text can be
    cut there and the parts encoded alone.  The first ``limit`` distinct chunks are remembered; the others are
    encoded again.  New chunks are encoded as one text and cut apart by the byte lengths of their ids.

    Where the vocabulary's ids are its merge order (tried on a probe of its own tokens), tiktoken does the merges
    from the same file, several times faster with the same ids; texts with special strings always go through
    ``tokenizers``.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known, self.heads = Tokenizer.from_file(path), limit, {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)  # one character stands for one byte
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = self._merger(path, vocabulary)

    def _merger(self, path: str, vocabulary: dict[str, int]):
        from tiktoken import Encoding

        spell = {c: b for b, c in _byte_letters().items()}
        plain = {t: i for t, i in vocabulary.items() if t not in self.special}
        if not all(c in spell for t in plain for c in t):
            return None
        ranks = {bytes(spell[c] for c in t): i for t, i in plain.items()}
        if not all(bytes([b]) in ranks for b in range(256)):
            return None
        merger = Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = "".join(t.decode(errors="ignore") + " " for t in list(ranks)[::97]) + " It's\r\n\t 12 345 x\u00e9\u4e2d  end "
        return merger if merger.encode_ordinary(probe) == self._slow_ids(probe) else None

    def _slow_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ids(self, text: str) -> np.ndarray:
        slow = self.merger is None or any(t in text for t in self.special)
        return np.array(self._slow_ids(text) if slow else self.merger.encode_ordinary(text), "<u4")

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """The first chunk, then the others without the space that leads each."""
        words = text.split(" ")
        if not _ODD_SPACE.search(text):
            return words
        chunks = words[:1]
        for x in words[1:]:
            if x and not x[0].isspace():
                chunks.append(x)
            else:
                chunks[-1] += " " + x
        return chunks

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids as little-endian unsigned 32-bit numbers."""
        get, rows, new = self.known.get, [], {}
        for text in texts:
            head, *rest = self._chunks(text)
            found = list(map(get, rest))
            if None in found:
                new.update((c, b"") for c, ids in zip(rest, found) if ids is None)
            rows.append((head, rest, found))
        chunks = list(new)
        for i in range(0, len(chunks), 8192):
            some = chunks[i:i + 8192]
            ids = self._ids(" " + " ".join(some))
            ends = np.cumsum([len(c.encode()) + 1 for c in some])
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
            raw, lo = ids.tobytes(), 0
            for c, hi in zip(some, (cuts * 4).tolist()):
                new[c] = raw[lo:hi]
                lo = hi
        out = []
        for head, rest, found in rows:
            first = self.heads.get(head)
            if first is None:
                first = self._ids(head).tobytes()
                if len(self.heads) < self.limit // 10:
                    self.heads[head] = first
            if None in found:
                found = [new[c] if ids is None else ids for c, ids in zip(rest, found)]
            out.append(np.frombuffer(first + b"".join(found), "<u4"))
        if len(self.known) < self.limit:
            self.known |= new
        return out


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, length: int, with_ids: bool) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens[, ids]) of at most ``length`` ids.

    A null or empty text has only the end id; repeated rows are cut each.
    """
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def cut(batches):
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], "<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                doc_ids, texts = part.column(0).to_pylist(), pc.fill_null(part.column(1), "").to_pylist()
                rows = []
                for doc_id, ids in zip(doc_ids, encode(texts)):
                    ids = np.concatenate((ids, end))
                    for start in range(0, len(ids), length):
                        piece = ids[start:start + length]
                        row = (doc_id, start, len(piece), zlib.crc32(piece), len(ids))
                        rows.append((*row, piece) if with_ids else row)
                arrays = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array([r[5].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size, taken in the given (decreasing) order.

    Leaf i of the tournament tree holds the free space of bin i, inner nodes the larger child: walking to the
    left child whenever it fits ends at the first bin that fits.
    """
    n = len(sizes)
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [0] * (2 * leaves)
    bins, offsets, opened = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        if tree[1] >= size:
            node = 1
            while node < leaves:
                node *= 2
                if tree[node] < size:
                    node += 1
        else:
            node = leaves + opened
            opened += 1
            tree[node] = capacity
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            tree[node] = best
            node //= 2
    return bins, offsets


def pack_pieces(pieces: DataFrame, length: int = 2048, group_pieces: int = 8192, seed: int = 7) -> DataFrame:
    """Add ``sequence_id`` (group in the high half, bin in the low) and ``offset`` to pieces."""
    pieces = keep(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    columns = pieces.columns
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))

    def place(key, table):
        order = pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        table = table.take(order)
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), length)
        out = table.select(columns)
        out = out.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins, pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("__group").applyInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, group_pieces: int = 8192,
                   seed: int = 7, with_ids: bool = True) -> DataFrame:
    """Packed pieces of all documents; with ``with_ids`` each carries its ids, without only their checksum."""
    return pack_pieces(cut_documents(docs, tokenizer_path, end_id, length, with_ids), length, group_pieces, seed)
