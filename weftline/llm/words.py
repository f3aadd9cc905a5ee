"""Words of whole texts as numpy arrays: one vectorised pass over the bytes of an Arrow batch.

A word is a longest run of characters outside ``[\\x20\\x09-\\x0D]``. All those separators
are single bytes in UTF-8, so words are found on bytes. A word is known by a 64-bit hash of
its bytes; the memory of a pass is a small multiple of ``SLICE_BYTES``, or of the longest
text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80

#: Powers of the base and of its inverse in steps of one and of ``_STEP``: any power is a product of two of them.
_STEP = 4096


def _progression(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_FINE, _FINE_INVERSE = (_progression(base, _STEP) for base in (_BASE, _BASE_INVERSE))
_COARSE_BASE, _COARSE_INVERSE_BASE = (np.uint64(pow(int(base), _STEP, 1 << 64)) for base in (_BASE, _BASE_INVERSE))


def _powers(n: int) -> np.ndarray:
    """The powers of the base from 0 to ``n - 1``; made anew each time, so that no worker keeps them."""
    return np.multiply.outer(_progression(_COARSE_BASE, n // _STEP + 1), _FINE).ravel()[:n]


def _inverses(at: np.ndarray, n: int) -> np.ndarray:
    """The powers ``at`` (below ``n``) of the inverse of the base."""
    return _progression(_COARSE_INVERSE_BASE, n // _STEP + 1)[at // _STEP] * _FINE_INVERSE[at % _STEP]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a copy)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Texts:
    """The texts of one slice: bytes, borders of texts, words and their hashes.

    ``of_word`` says which bytes belong to words; ``lower`` folds A-Z in hashes.
    """

    def __init__(self, column: pa.Array, lower: bool = False, of_word: np.ndarray = ~SPACE):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        self.bytes = np.frombuffer(buffers[2] or b"", np.uint8)[first:last]
        self.border = offsets - first
        self.lower = lower
        n = len(self.bytes)
        inside = of_word[self.bytes]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        begins = self.border[:-1]
        begins = begins[begins < n]
        opens[begins] = inside[begins]
        closes = inside.copy()
        closes[:-1] &= opens[1:] | ~inside[1:]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        #: Of text i, the words ``first[i]`` to ``first[i + 1] - 1``.
        self.first = np.searchsorted(self.start, self.border)

    def __len__(self) -> int:
        return len(self.border) - 1

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        n = len(self.bytes)
        if not hasattr(self, "_sums"):
            terms = _powers(n)
            terms *= (_BYTE[_LOWER] if self.lower else _BYTE)[self.bytes]
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(terms, out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * _inverses(start, n + 1) + (end - start).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def word_text(self) -> np.ndarray:
        """The number of the text each word belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def code_points(self) -> np.ndarray:
        """Running count of code points: ``[end] - [start]`` of a byte span is its length."""
        if not hasattr(self, "_points"):
            self._points = np.zeros(len(self.bytes) + 1, np.int64)
            np.cumsum(LEAD[self.bytes], out=self._points[1:])
        return self._points


def sums(values: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive borders; empty ones give 0."""
    running = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=running[1:])
    return running[border[1:]] - running[border[:-1]]


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``words[i : i + k]`` for every i, without regard to texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``size`` bytes of text, at least one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)
