"""Static binary-fuse filters: three slots per key, no false negatives, 16-bit fingerprints.

A filter is built once from distinct 64-bit keys and never changes. A key that was not put
in passes with probability ``2 ** -16``. All steps are whole-array operations.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from .words import mix


class Filter(NamedTuple):
    seed: int
    segment: int
    segments: int
    slots: np.ndarray


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of start segments for n keys."""
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
    return segment, max(1, math.ceil(n * factor / segment) - 2 + 1)


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + np.uint64(seed))
    base = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
    low = np.uint64(segment - 1)
    at = np.stack([base + (mix(h + np.uint64(i)) & low).astype(np.int64) + i * segment for i in range(3)])
    return at, ((h ^ (h >> np.uint64(21))) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> Filter:
    """The filter of distinct keys; new seeds are tried until every key finds a slot."""
    n = len(keys)
    segment, segments = _shape(n)
    size = segment * (segments + 2)
    for seed in range(1, 1000):
        if seed % 10 == 0:
            segments += max(1, segments // 8)
            size = segment * (segments + 2)
        at, mark = _slots(keys, seed, segment, segments)
        ids = np.arange(n, dtype=np.int64)
        count = np.zeros(size, np.int64)
        held = np.zeros(size, np.int64)
        for row in at:
            count += np.bincount(row, minlength=size)
            np.bitwise_xor.at(held, row, ids)
        order, left = [], n
        single = np.flatnonzero(count == 1)
        while len(single):
            keys_now, first = np.unique(held[single], return_index=True)
            slots_now = single[first]
            order.append((keys_now, slots_now))
            left -= len(keys_now)
            touched = at[:, keys_now]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, keys_now)
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if left:
            continue
        slots = np.zeros(size, np.uint16)
        for keys_now, slots_now in reversed(order):
            rows = at[:, keys_now]
            own = slots[rows[0]] ^ slots[rows[1]] ^ slots[rows[2]]
            slots[slots_now] ^= own ^ mark[keys_now]
        return Filter(seed, segment, segments, slots)
    raise ValueError("keys are not distinct")


def contains(f: Filter, keys: np.ndarray) -> np.ndarray:
    at, mark = _slots(keys, f.seed, f.segment, f.segments)
    return (f.slots[at[0]] ^ f.slots[at[1]] ^ f.slots[at[2]]) == mark
