"""Deterministic pseudo-random draws as column expressions.

A draw is a function of a seed and key columns, so task retries and re-runs give the same data.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def uniform(seed: str, *keys: Column | str) -> Column:
    """Uniform number in (0, 1]: first 32 bits of md5(seed:key:…), shifted off zero."""
    parts = [F.lit(seed)] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double")
    return (bits + 1.0) / F.lit(TWO32)


def uniform_pair(seed: str, *keys: Column | str) -> tuple[Column, Column]:
    """Two independent uniforms out of one md5."""
    parts = [F.lit(seed)] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    h = F.md5(F.concat_ws(":", *parts))
    one = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 1.0) / F.lit(TWO32)
    two = (F.conv(F.substring(h, 9, 8), 16, 10).cast("double") + 1.0) / F.lit(TWO32)
    return one, two


def normal(seed: str, *keys: Column | str) -> Column:
    """Standard normal number by Box-Muller."""
    u, v = uniform_pair(seed, *keys)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def replicates(df, n: int, seed: str, *keys: str):
    """Multiply rows by ``n`` replicates with one uniform each (columns ``rep`` and ``u``).

    A digest holds 128 bits, so one md5 serves four replicates.
    """
    blocks = df.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 4))))
    h = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("__b").cast("string")))
    four = F.array(*[(F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("double") + 1.0) / F.lit(TWO32) for i in range(4)])
    out = blocks.withColumn("__h", h).select(*df.columns, "__b", F.posexplode(four).alias("__i", "u"))
    return out.withColumn("rep", F.col("__b") * 4 + F.col("__i") + 1).where(F.col("rep") <= n).drop("__b", "__i")


def sql_replicate(seed: str, key_sql: str) -> str:
    """The draw of replicate ``rep`` (a column) in SQL."""
    return (f"((('0x' || substr(md5('{seed}:' || {key_sql} || ':' || ((rep - 1) // 4)), ((rep - 1) % 4) * 8 + 1, 8))::BIGINT)::DOUBLE "
            f"+ 1.0) / 4294967296.0")


def poisson1(u: Column, most: int = 12) -> Column:
    """Poisson(1) count from one uniform by inversion (the tail beyond ``most`` is below the resolution of a 32-bit draw)."""
    cdf, term, out = 0.0, math.exp(-1.0), F.lit(most)
    bounds = []
    for i in range(most):
        cdf += term
        bounds.append(cdf)
        term /= i + 1
    for i in reversed(range(most)):
        out = F.when(u <= F.lit(bounds[i]), i).otherwise(out)
    return out.cast("long")


def sql_uniform(seed: str, key_sql: str, part: int = 0) -> str:
    """The same draw in ANSI-style SQL, used by the checks."""
    start = 1 + 8 * part
    return f"((('0x' || substr(md5('{seed}:' || {key_sql}), {start}, 8))::BIGINT)::DOUBLE + 1.0) / 4294967296.0"


def sql_normal(seed: str, key_sql: str) -> str:
    return (f"(sqrt(-2.0 * ln({sql_uniform(seed, key_sql, 0)})) * "
            f"cos(2.0 * pi() * ({sql_uniform(seed, key_sql, 1)})))")


def sql_poisson1(u_sql: str, most: int = 12) -> str:
    cdf, term, arms = 0.0, math.exp(-1.0), []
    for i in range(most):
        cdf += term
        arms.append(f"WHEN {u_sql} <= {cdf!r} THEN {i}")
        term /= i + 1
    return "CASE " + " ".join(arms) + f" ELSE {most} END"


#: Shift amounts and constants of the digest (RFC 1321).
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * TWO32) & 0xFFFFFFFF for i in range(64)]
#: Draws whose words lie in the cache of a core at one time.
_CHUNK = 16384
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Digests:
    """First words of md5(head + tail) of one head and many tails, with numpy: the draws of one row at once.

    The tails are laid out as message blocks once for each length of the head, so a row only adds its head.  Head and
    tail are ASCII and together below 56 bytes; longer ones are digested one by one.
    """

    def __init__(self, tails: list[str]):
        self.tails, self.blocks = [t.encode() for t in tails], {}
        self.longest = max(map(len, self.tails), default=0)

    def _block(self, head: int) -> list:
        if head not in self.blocks:
            if len(self.blocks) >= 16:
                self.blocks.clear()
            raw = np.zeros((len(self.tails), 64), np.uint8)
            sizes = np.array([len(t) for t in self.tails])
            text = np.frombuffer(b"".join(t.ljust(self.longest, b"\0") for t in self.tails), np.uint8).reshape(len(self.tails), -1)
            raw[:, head:head + self.longest] = text
            raw[np.arange(len(self.tails)), head + sizes] = 0x80
            raw[:, 56:64] = ((head + sizes) * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
            words = np.ascontiguousarray(raw.view("<u4").T)
            self.blocks[head] = [w if w.any() else None for w in words]
        return self.blocks[head]

    def words(self, head: str, n: int | None = None) -> list[np.ndarray]:
        """The four words of each of the first ``n`` tails, as numbers of their eight hexadecimal digits."""
        start, n = head.encode(), len(self.tails) if n is None else n
        if len(start) + self.longest >= 56:
            whole = b"".join(hashlib.md5(start + t).digest() for t in self.tails[:n])
            return list(np.frombuffer(whole, ">u4").astype(np.uint32).reshape(-1, 4).T)
        fixed = np.frombuffer(start.ljust(64, b"\0"), "<u4")
        out = [np.empty(n, np.uint32) for _ in range(4)]
        for lo in range(0, n, _CHUNK):
            hi = min(n, lo + _CHUNK)
            m = [int(f) if b is None else (b[lo:hi] | f if f else b[lo:hi]) for b, f in zip(self._block(len(start)), fixed)]
            for o, w in zip(out, _md5(m, hi - lo)):
                o[lo:hi] = w.byteswap()
        return out

    def words_of(self, heads: list[str], sizes: list[int]) -> list[np.ndarray]:
        """The four words of the first ``sizes[i]`` tails of every head, one head after the other.

        Heads of one length are digested together, so that few tails for each of many heads cost no more than many for one.
        """
        at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        out = [np.empty(at[-1], np.uint32) for _ in range(4)]
        same: dict[int, list[int]] = {}
        for i, h in enumerate(heads):
            same.setdefault(len(h.encode()), []).append(i)
        for length, members in same.items():
            while members:
                n = 1 + int(np.searchsorted(np.cumsum([sizes[i] for i in members])[1:], 2 * _CHUNK, side="right"))
                some, members = members[:n], members[n:]
                if n == 1 or length + self.longest >= 56:
                    for i in some:
                        for o, w in zip(out, self.words(heads[i], sizes[i])):
                            o[at[i]:at[i + 1]] = w
                    continue
                count = [sizes[i] for i in some]
                tail = np.concatenate([np.arange(c) for c in count])
                fixed = np.stack([np.frombuffer(heads[i].encode().ljust(64, b"\0"), "<u4") for i in some])
                m = []
                for b, f in zip(self._block(length), fixed.T):
                    f = int(f[0]) if (f == f[0]).all() else np.repeat(f, count)
                    m.append(f if b is None else b[tail] | f if isinstance(f, np.ndarray) or f else b[tail])
                place = np.concatenate([np.arange(at[i], at[i + 1]) for i in some])
                for lo in range(0, len(tail), _CHUNK):
                    hi = min(len(tail), lo + _CHUNK)
                    for o, w in zip(out, _md5([x if isinstance(x, int) else x[lo:hi] for x in m], hi - lo)):
                        o[place[lo:hi]] = w.byteswap()
        return out

    def uniforms(self, head: str, n: int | None = None, parts: int = 1) -> list[np.ndarray]:
        """Uniform numbers in (0, 1] as ``uniform`` gives them, from the first ``parts`` words."""
        return [(w + 1.0) / TWO32 for w in self.words(head, n)[:parts]]

    def normals(self, head: str, n: int | None = None) -> np.ndarray:
        """Standard normal numbers as ``normal`` gives them."""
        u, v = self.uniforms(head, n, 2)
        return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * math.pi * v)


def _md5(m: list, n: int) -> list[np.ndarray]:
    """The digest of ``n`` single blocks; a word is an array, or one number for all of them."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        word = m[g]
        if isinstance(word, int):
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        else:
            f += np.uint32(_SINES[i])
            f += word
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    for x, y in zip((a, b, c, d), _START):
        x += np.uint32(y)
    return [a, b, c, d]


def digests(tail) -> Callable[[int], Digests]:
    """Function that gives the tails ``tail(i)`` (a list of texts) of i = 0, 1, … for at least the first ``n``, in that order."""
    made: list[tuple[int, Digests]] = []

    def get(n: int) -> Digests:
        if not made or made[0][0] < n:
            size = 1 << max(n - 1, 31).bit_length()
            made[:] = [(size, Digests([t for i in range(size) for t in tail(i)]))]
        return made[0][1]

    return get


def poisson_bounds(most: int = 12) -> np.ndarray:
    """Bounds of ``poisson1``: the count is the number of bounds below the uniform number."""
    terms = [math.exp(-1.0)]
    for i in range(most - 1):
        terms.append(terms[-1] / (i + 1))
    return np.array(list(itertools.accumulate(terms)))


class PoissonCounts:
    """Counts of ``poisson1`` from words of digests: by their upper half, and exactly where a bound falls into that."""

    def __init__(self, most: int = 12):
        self.bounds = poisson_bounds(most)
        first = np.searchsorted(self.bounds, (np.arange(65536) * 65536.0 + 1.0) / TWO32)
        last = np.searchsorted(self.bounds, (np.arange(65536) * 65536.0 + 65536.0) / TWO32)
        self.table = np.where(first == last, first, -1).astype(np.int8)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        counts = self.table[words >> np.uint32(16)]
        open_ = np.nonzero(counts < 0)
        counts[open_] = np.searchsorted(self.bounds, (words[open_] + 1.0) / TWO32)
        return counts
