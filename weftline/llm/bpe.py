"""Byte-level BPE by ranks: encode and decode whole texts.

Each match of the split pattern is merged on its own, the leftmost pair of the lowest rank
first. The matches of a batch lie in one linked list with gaps between them and share one
queue of ranks: a bitmap of three levels says which ranks have candidate pairs,
find-first-set gives the lowest, and the bucket of a rank holds the list positions where
such pairs begin. A bucket is merged as a whole; entries whose pair has changed since are
skipped. Every step is on arrays, and n positions take n log n of them, so a match of a
million characters is no problem.

A Python worker keeps the ids of the parts of texts it has seen (``parts.PartCache``). NULL
counts as empty: no ids. Repeated rows give repeated rows, an empty table an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .parts import PartCache, gather
from .words import slices

BATCH_BYTES = 8 << 20
#: A part of more characters is split into matches bit by bit.
LONG_CHARS = 8 << 20
MATCHES = 500_000


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: base64 of the token, a space, the rank."""
    pairs = (line.split() for line in lines.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class RankSet:
    """A set of ranks as a bitmap of three levels of 64-bit words."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def remove(self, rank: int) -> None:
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << ((rank >> 6) & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))

    def first(self) -> int:
        """The lowest member; the set must not be empty."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) + (word & -word).bit_length() - 1
        word = self.low[b]
        return (b << 6) + (word & -word).bit_length() - 1


class Merges:
    """The pairs of a rank table that can be merged, and the queue that merges them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n_ranks = max(ranks.values(), default=0) + 1
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("every byte needs a rank")
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is None or right is None:
                    continue
                keys.append(left << 32 | right)
                made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.made = np.array(made, np.int64)[order]
        #: Ranks whose merge can open a pair of a lower rank.
        parts = np.concatenate([self.keys >> 32, self.keys & 0xFFFFFFFF])
        lower = np.concatenate([self.made, self.made]) < parts
        self.restless = set(parts[lower].tolist())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges to, -1 for none."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def _until_lower(self, rank, at, ids, after, before, piece) -> np.ndarray:
        """What can be merged at once of a sorted bucket.

        In each piece, entries are merged up to and with the first whose merge opens a pair
        of a lower rank; that pair comes before the entries behind it.
        """
        following, previous = after[after[at]], before[at]
        left = ids[previous]
        left[1:] = np.where(after[after[at[:-1]]] == at[1:], rank, left[1:])
        made = np.full(len(at), rank)
        opened = [self.rank(made, ids[following]), self.rank(left, made)]
        lower = np.zeros(len(at), dtype=bool)
        for found in opened:
            lower |= (found >= 0) & (found < rank)
        before_it = np.cumsum(lower) - lower
        owner = piece[at]
        first = np.searchsorted(owner, owner)
        return at[before_it == before_it[first]]

    def run(self, data: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``data[border[i] : border[i + 1]]``, and the borders of their ids."""
        n = len(data)
        ids = self.byte[data]
        # One more position stands for "no neighbour" at either end.
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[border[1:] - 1] = n
        before[border[:-1]] = n
        pair = np.full(n + 1, -1)
        inner = np.flatnonzero(after[:n] < n)
        pair[inner] = self.rank(ids[inner], ids[inner + 1])
        alive = np.ones(n + 1, dtype=bool)
        ids = np.append(ids, -1)
        piece = np.repeat(np.arange(len(border) - 1), np.diff(border))
        queue, buckets = RankSet(self.n_ranks), {}

        def offer(at: np.ndarray) -> None:
            found = pair[at]
            order = np.argsort(found, kind="stable")
            found, at = found[order], at[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                rank = int(found[a]) if b > a else -1
                if rank < 0:
                    continue
                if rank in buckets:
                    buckets[rank].append(at[a:b])
                else:
                    buckets[rank] = [at[a:b]]
                    queue.add(rank)

        offer(inner)
        while queue.top:
            rank = queue.first()
            queue.remove(rank)
            entries = buckets.pop(rank)
            at = np.unique(np.concatenate(entries))
            at = valid = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                # Pairs that overlap, as in "aaa": every other one from the left.
                chained = after[at[:-1]] == at[1:]
                if chained.any():
                    place = np.arange(len(at))
                    opens = np.where(np.append(True, ~chained), place, 0)
                    at = at[(place - np.maximum.accumulate(opens)) % 2 == 0]
                if rank in self.restless:
                    at = self._until_lower(rank, at, ids, after, before, piece)
                    # Also those left out of a chain: a lower merge may free them.
                    wait = np.setdiff1d(valid, at, assume_unique=True)
                    if len(wait):
                        buckets[rank] = [wait]
                        queue.add(rank)
            gone = after[at]
            ids[at] = rank
            alive[gone] = False
            pair[gone] = -1
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at
            before_at = before[at]
            changed = np.concatenate([at, before_at[before_at < n]]) if len(at) else at
            right = after[changed]
            pair[changed] = np.where(right < n, self.rank(ids[changed], ids[right]), -1)
            offer(changed)
        kept = alive[:n]
        totals = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=totals[1:])
        return ids[:n][kept], totals[border]


class Codec:
    """Encoder and decoder of one rank table, with the cache of a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges = Merges(ranks)
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.parts = PartCache(self._new)
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_border = np.cumsum([0, *map(len, tokens)])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def pieces(self, matches: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian, 32 bits) of different matches."""
        out, rest = {}, []
        for match in matches:
            rank = self.ranks.get(match.encode())
            if rank is None:
                rest.append(match)
            else:
                out[match] = rank.to_bytes(4, "little")
        if rest:
            raw = [match.encode() for match in rest]
            border = np.cumsum([0, *map(len, raw)])
            ids, cuts = self.merges.run(np.frombuffer(b"".join(raw), np.uint8), border)
            coded, cuts = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
            out.update((m, coded[a:b]) for m, a, b in zip(rest, cuts, cuts[1:]))
        return out

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of different parts that are not known yet."""
        short = [part for part in parts if len(part) <= LONG_CHARS]
        split = [self.pattern.findall(part) for part in short]
        pieces = self.pieces(set().union(*split))
        out = {part: b"".join(map(pieces.__getitem__, matches)) for part, matches in zip(short, split)}
        for part in parts:
            if len(part) > LONG_CHARS:
                matches = (m.group() for m in self.pattern.finditer(part))
                coded = []
                for some in batched(matches, MATCHES):
                    pieces = self.pieces(set(some))
                    coded.append(b"".join(map(pieces.__getitem__, some)))
                out[part] = b"".join(coded)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the border of each text among them."""
        return self.parts.encode(column)

    def decode(self, ids: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all sequences of ids in a row, and the border of each among them."""
        data, totals = gather(self.token_bytes, self.token_border, ids)
        return data, totals[border]


@cache
def _codec(lines: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(lines), pattern)


def encoded(docs: DataFrame, rank_file: str, pattern: str, column: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every row; ``rank_file`` is read on the driver."""

    def make(codec: Codec, ids: np.ndarray, border: np.ndarray) -> dict:
        return {"ids": pa.ListArray.from_arrays(border.astype(np.int32), ids.astype(np.int32))}

    return _coded(docs, rank_file, pattern, column, "ids array<int>", make)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, column: str = "text") -> DataFrame:
    """Per row: ``n_tokens``, SHA-256 of the ids (little-endian, 32 bits) and of the bytes decoded from them."""

    def make(codec: Codec, ids: np.ndarray, border: np.ndarray) -> dict:
        data, ends = codec.decode(ids, border)
        return {
            "n_tokens": np.diff(border),
            "ids_sha256": [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(border, border[1:])],
            "decoded_sha256": [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends, ends[1:])],
        }

    return _coded(docs, rank_file, pattern, column, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def decoded(rows: DataFrame, rank_file: str, pattern: str, column: str = "ids") -> DataFrame:
    """``doc_id`` and ``bytes`` of every row of ids; NULL and empty arrays give no bytes."""
    shared = _share(rows, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            lists = [ids or [] for ids in batch.column(column).to_pylist()]
            border = np.cumsum([0, *map(len, lists)])
            data, ends = codec.decode(np.array([i for ids in lists for i in ids], np.int64), border)
            out = [data[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "bytes": pa.array(out, pa.binary())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", column).mapInArrow(run, f"doc_id {kind}, bytes binary")


def _share(df: DataFrame, rank_file: str):
    with open(rank_file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _coded(docs: DataFrame, rank_file: str, pattern: str, column: str, schema: str, make: Callable) -> DataFrame:
    shared = _share(docs, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, column, BATCH_BYTES):
                yield pa.record_batch({"doc_id": part.column("doc_id"), **make(codec, *codec.encode(part.column(column)))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", column).mapInArrow(run, f"doc_id {kind}, {schema}")
