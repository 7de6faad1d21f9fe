"""The words of whole texts as numbers, for many texts at once in numpy.

A word is a run of bytes other than the six ASCII spaces (``[^\\x20\\x09-\\x0D]+`` of the text, as no other character's UTF-8 holds such a byte).
Words and stretches of words are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
from itertools import compress

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E6C63D0876A9A47  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of words that are hashed together; powers of this length are kept.
_CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit of an unsigned number over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


_kept_powers = functools.cache(_powers)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n + 1`` powers of the base and of its inverse, modulo 2^64; only those of the usual length are kept."""
    of, m = (_kept_powers, _CHUNK) if n <= _CHUNK else (_powers, n)
    return of(_BASE, m)[: n + 1], of(_INVERSE, m)[: n + 1]


class Words:
    """The words of a batch of texts: ``starts`` and ``ends`` in ``data``; text i has the words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        low = int(offsets[0])
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[low : int(offsets[-1])]
        self.offsets = offsets - low
        word = np.concatenate(([False], ~_SPACE[self.data], [False]))
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True  # texts stand side by side
        self.starts = np.flatnonzero(word[1:] & (edge | ~word[:-1]))
        self.ends = np.flatnonzero(word[:-1] & (edge | ~word[1:]))
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """An unsigned 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + _CHUNK, "right")))
            low, high = int(self.starts[a]), int(self.ends[b - 1])
            up, down = powers(high - low)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data[low:high]] * up[:-1], dtype=np.uint64)))
            s, e = self.starts[a:b] - low, self.ends[a:b] - low
            out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            a = b
        return out

    def kept(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Text i with one space between its words, of which only those that ``keep`` marks remain."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        text = self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()
        if keep is None or keep.all():
            plain = b - a == 0 or (len(text) == int((self.ends[a:b] - self.starts[a:b]).sum()) + b - a - 1 and text.count(b" ") == b - a - 1)
            return (text if b > a else b"") if plain else b" ".join(text.split())
        return b" ".join(compress(text.split(), keep.tolist()))


class Stretches:
    """Hashes of stretches of words."""

    def __init__(self, words: np.ndarray):
        up, self.down = powers(len(words))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])
