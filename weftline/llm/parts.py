"""Ids of whole texts, made once for every distinct part of them.

Tokenizers that split a text into words before anything else give a text the ids of its
parts, one after the other, if no word runs across the end of a part. Distinct parts are
encoded once per Python worker, as far as the cache goes: at most ``CACHE`` parts (or as
many as the caller says) of at most ``CACHE_CHARS`` characters. All others are simply encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import SPACE

CACHE = 600_000
CACHE_CHARS = 64

#: White space beyond ASCII (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000) in UTF-8.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def units(data: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Borders of parts of the texts that can be split into matches one by one.

    A part ends before a single blank between two characters that are no white space, and
    between an ASCII letter and an ASCII mark other than the apostrophe: no match of the
    split pattern runs across such a place or looks behind it. White space beyond ASCII is
    made of bytes from 0x80 on; next to those bytes a part ends at a blank only if the
    slice has no such white space at all.
    """
    n = len(data)
    solid = ~SPACE[data] & ((data < 0x1C) | (data > 0x1F))
    if WIDE_SPACE.search(data.tobytes()):
        solid &= data < 0x80
    cut = np.zeros(n, dtype=bool)
    cut[1:-1] = (data[1:-1] == 32) & solid[:-2] & solid[2:]
    letter, mark = _LETTER[data], _MARK[data]
    cut[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    inner = border[(border > 0) & (border < n)]
    cut[inner] = True
    return np.concatenate([[0], np.flatnonzero(cut), [n]]) if n else np.zeros(1, np.int64)


class PartCache:
    """Encodes columns of texts; ``make`` gives the ids (little-endian, 32 bits) of new, different parts.

    ``lower`` is for tokenizers that fold A-Z anyway: it makes the parts fewer.
    """

    def __init__(self, make: Callable[[list[str]], dict[str, bytes]], lower: bool = False, size: int = CACHE):
        self.make = make
        self.lower = lower
        self.size = size
        self.known: dict[str, bytes] = {}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the border of each text among them. NULL counts as empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        buffers = column.buffers()
        border = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(buffers[2] or b"", np.uint8)[border[0] : border[-1]]
        border = border - border[0]
        if self.lower:
            data = _LOWER[data]
        cuts = units(data, border)
        if len(cuts) < 2:
            return np.empty(0, "<u4"), np.zeros(len(column) + 1, np.int64)
        parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data))
        codes = parts.dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        made = self.make([part for part in distinct if part not in self.known])
        coded = [made[part] if part in made else self.known[part] for part in distinct]
        if len(self.known) + len(made) > self.size:
            self.known.clear()
        self.known.update(islice(((m, v) for m, v in made.items() if len(m) <= CACHE_CHARS), self.size))
        start = np.cumsum([0, *map(len, coded)]) // 4
        ids, totals = gather(np.frombuffer(b"".join(coded), "<u4"), start, codes.indices.to_numpy())
        return ids, totals[np.searchsorted(cuts, border)]


def gather(values: np.ndarray, border: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put together the runs ``values[border[i] : border[i + 1]]`` of all i in ``which``; and their borders."""
    first, length = border[which], border[which + 1] - border[which]
    totals = np.zeros(len(which) + 1, np.int64)
    np.cumsum(length, out=totals[1:])
    at = np.repeat(first - totals[:-1], length)
    at += np.arange(len(at))
    return values[at], totals
