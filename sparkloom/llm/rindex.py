"""A run-length index of many short texts: run-compressed Burrows-Wheeler transform with sampled run ends.

Built with numpy for one bounded group of texts.  ``least_documents`` streams texts through it from right to left,
all in step: the matching statistics (interval and length, cut at ``length``) come from run-length ranks alone.
"""

from __future__ import annotations

import numpy as np


#: Symbols of the first sort key, and the width (two doublings on) whose ranks tell the groups apart.
WORD, LEVEL = 7, 28


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    sorted_keys = keys[order]
    step = np.zeros(len(keys), np.int64)
    step[1:] = sorted_keys[1:] != sorted_keys[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step) + 1
    return out


class RunLengthIndex:
    """``texts`` are the bytes of all texts one after another, ``ends`` where each stops, ``documents`` their ids."""

    def __init__(self, texts: np.ndarray, ends: np.ndarray, documents: np.ndarray, length: int):
        self.length = length
        count, sizes = len(ends), np.diff(ends, prepend=0)
        n = len(texts) + count
        owner = np.repeat(np.arange(count), sizes + 1)
        stops = ends + np.arange(count)
        symbols = np.zeros(n, np.int64)  # 0 ends a text, bytes are 1 to 256
        inside = np.ones(n, np.bool_)
        inside[stops] = False
        symbols[inside] = texts.astype(np.int64) + 1
        left = stops[owner] - np.arange(n)  # symbols before the end of the text
        suffixes, level = self._suffixes(symbols, left, int(sizes.max(initial=0)) + 1)

        before = suffixes - 1  # the Burrows-Wheeler transform, 0 where a text begins
        begins = np.concatenate(([True], ~inside[:-1]))
        transform = np.where(begins[suffixes], 0, symbols[np.maximum(before, 0)])
        run_start = np.flatnonzero(np.concatenate(([True], transform[1:] != transform[:-1])))
        self.rows, self.run_start, self.run_symbol = n, run_start, transform[run_start]
        run_size = np.diff(run_start, append=n)
        self.end_sample = suffixes[run_start + run_size - 1]  # text position at the last row of every run
        self.runs = len(run_start)
        by_symbol = np.lexsort((np.arange(self.runs), self.run_symbol))
        self.run_key = self.run_symbol[by_symbol] * (self.runs + 1) + by_symbol
        size_before = np.concatenate(([0], np.cumsum(run_size[by_symbol])))
        symbol_first = np.searchsorted(self.run_symbol[by_symbol], np.arange(258))
        self.rank_before = size_before - size_before[symbol_first][np.append(self.run_symbol[by_symbol], 257)]
        self.ranks_end = size_before
        self.symbol_first = symbol_first
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=257))))

        # rows whose suffixes share the first ``length`` symbols, with the least document of each such group
        cut = length - LEVEL
        second = np.where(left > cut, level[np.minimum(np.arange(n) + cut, n - 1)], -1)
        a, b = level[suffixes], second[suffixes]
        full = left[suffixes] >= length
        head = np.ones(n, np.bool_)
        head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | ~full[1:] | ~full[:-1]
        self.heads = np.flatnonzero(head)
        self.least = np.minimum.reduceat(documents[owner[suffixes]], self.heads)

    @staticmethod
    def _suffixes(symbols: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order within texts (equal suffixes by text), and ranks of the first ``LEVEL`` symbols."""
        n = len(symbols)
        key, width, level = symbols.copy(), 1, None
        for j in range(1, WORD):  # seven symbols of nine bits are one key
            ahead = np.zeros(n, np.int64)
            ahead[:max(0, n - j)] = symbols[j:]
            ahead[left < j] = 0
            key = (key << 9) | ahead
        rank, width = _dense(key), WORD
        while width < max(longest, LEVEL):
            ahead = np.zeros(n, np.int64)
            ahead[:max(0, n - width)] = rank[width:]
            ahead[left < width] = 0
            rank = _dense(rank * np.int64(n + 2) + ahead)
            width *= 2
            if width == LEVEL:
                level = rank
        return np.argsort(rank * np.int64(n + 1) + np.arange(n)), level

    def _rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many of the first ``row`` symbols of the transform are ``symbol``."""
        run = np.searchsorted(self.run_start, row, side="right") - 1
        k = np.searchsorted(self.run_key, symbol * (self.runs + 1) + run)
        before = self.ranks_end[k] - self.ranks_end[self.symbol_first[symbol]]
        return before + np.where(self.run_symbol[run] == symbol, row - self.run_start[run], 0)

    def least_documents(self, texts: np.ndarray, ends: np.ndarray, missing: int) -> np.ndarray:
        """For every position of the texts: the least document that holds the ``length`` bytes from there on.

        ``missing`` where no document does, or where fewer bytes are left in the text.
        """
        starts = np.concatenate(([0], ends[:-1]))
        out = np.full(len(texts), missing, np.int64)
        at, low = ends - 1, starts
        lo, hi, matched = np.zeros(len(ends), np.int64), np.full(len(ends), self.rows, np.int64), np.zeros(len(ends), np.int64)
        live = np.flatnonzero(at >= low)
        while len(live):
            symbol = texts[at[live]].astype(np.int64) + 1
            a = self.smaller[symbol] + self._rank(symbol, lo[live])
            b = self.smaller[symbol] + self._rank(symbol, hi[live])
            lost = a >= b  # start again behind this byte
            lo[live], hi[live] = np.where(lost, 0, a), np.where(lost, self.rows, b)
            matched[live] = np.where(lost, 0, matched[live] + 1)
            full = live[matched[live] >= self.length]
            if len(full):
                group = np.searchsorted(self.heads, lo[full], side="right") - 1
                out[at[full]] = self.least[group]
                lo[full] = self.heads[group]  # forget what is matched beyond ``length``
                hi[full] = np.append(self.heads, self.rows)[group + 1]
                matched[full] = self.length
            at[live] -= 1
            live = live[at[live] >= low[live]]
        return out
