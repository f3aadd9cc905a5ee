"""Best-fit packing of documents into sequences of a fixed capacity, in bulk rounds.

Documents become pieces of 1 to ``capacity`` ids; only longer ones are cut. Pieces are
sorted by range over the whole cluster, so a piece is known by its length and its rank
among the pieces of that length. A round sweeps the sorted gaps, tightest first, against
the sorted pieces, longest first: each gap takes the longest piece left that fits, gaps that
want the same length are served by rank, all gaps are updated, and the sweep is repeated.
When no gap takes anything, as many sequences are opened as the ids left need at least.

A sweep needs counts alone: gaps and pieces have at most ``capacity`` different sizes,
gaps of one size that arose together are a run of sequence numbers. So the plan of a sweep
is a list of moves (length, ranks from, how many, sequence numbers from, offset), whose
number depends on the sizes and rounds and not on the number of rows. The rows find their
move by length and rank, each in its own task.

NULL and empty texts are one piece of the end id. Repeated rows are packed each for itself,
also under one ``doc_id`` or NULL. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import with_ordinal
from ..session import cut_lineage
from .parts import PartCache
from .words import slices

CAPACITY = 4096
END = 1
BATCH_BYTES = 8 << 20
WORD = re.compile(" ?[a-z]+")
WORDS = 5000


@cache
def _parts(model: str) -> PartCache:
    # Tasks share the cores already.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    tokenizer.encode_special_tokens = True
    suffix = json.loads(model)["model"]["end_of_word_suffix"]
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode(parts: list[str]) -> list:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def make(parts: list[str]) -> dict[str, bytes]:
        # A blank and letters are one word, whose last id is the only one with the suffix. So many
        # words can be encoded as one text.
        words = [part for part in parts if WORD.fullmatch(part)]
        out = {}
        for some in batched(words, WORDS):
            ids = encode(["".join(w if w[0] == " " else " " + w for w in some)])[0]
            stops = np.flatnonzero(ends[ids]) + 1
            if len(stops) != len(some):
                out.update((w, e.tobytes()) for w, e in zip(some, encode(list(some))))
                continue
            out.update((w, own.tobytes()) for w, own in zip(some, np.split(ids, stops[:-1])))
        rest = [part for part in parts if part not in out]
        out.update((part, e.tobytes()) for part, e in zip(rest, encode(rest)))
        return out

    return PartCache(make, lower=True)


def tokenized(column: pa.Array, model: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with ``end`` behind, and the border of each."""
    ids, border = _parts(model).encode(column)
    shifted = border + np.arange(len(border))
    out = np.full(shifted[-1], end, "<u4")
    own = np.ones(shifted[-1], dtype=bool)
    own[shifted[1:] - 1] = False
    out[own] = ids
    return out, shifted


def pieces(docs: DataFrame, model_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, on demand, ``ids``."""
    with open(model_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                ids, border = tokenized(part.column("text"), shared.value)
                totals = np.diff(border)
                n_pieces = -(-totals // capacity)
                owner = np.repeat(np.arange(len(totals)), n_pieces)
                firsts = np.cumsum(n_pieces) - n_pieces
                number = np.arange(len(owner)) - firsts[owner]
                start = number * capacity
                length = np.minimum(totals[owner] - start, capacity)
                begin = border[owner] + start
                out = {
                    "doc_id": part.column("doc_id").take(pa.array(owner)),
                    "piece": number.astype(np.int32),
                    "start": start,
                    "length": length,
                    "ids_crc32": np.array([zlib.crc32(ids[a : a + n]) for a, n in zip(begin, length)], np.int64),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(np.append(begin, border[-1]).astype(np.int32), ids.astype(np.int32))
                yield pa.record_batch(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Moves for ``counts`` pieces of each length: rows of length, rank, number, sequence, offset.

    Pieces ``rank .. rank + number - 1`` of a length go to the sequences from ``sequence``
    on, one each, at ``offset``. Sorted by length and rank.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    total = sum(length * n for length, n in left.items())
    moves: list[tuple[int, int, int, int, int]] = []
    runs: list[tuple[int, int, int]] = []  # gap, first sequence, number
    opened = 0
    while left:
        runs.sort()
        lengths = sorted(left)
        stack: list[int] = []
        after: list[tuple[int, int, int]] = []
        moved, seen = False, 0
        for gap, first, n in runs:
            while seen < len(lengths) and lengths[seen] <= gap:
                stack.append(lengths[seen])
                seen += 1
            while n and stack:
                length = stack[-1]
                take = min(n, left[length])
                moves.append((length, used[length], take, first, capacity - gap))
                moved = True
                total -= length * take
                used[length] += take
                left[length] -= take
                if not left[length]:
                    del left[length]
                    stack.pop()
                if gap > length:
                    after.append((gap - length, first, take))
                first, n = first + take, n - take
            if n:
                after.append((gap, first, n))
        least = min(left, default=0)
        runs = [run for run in _joined(after) if run[0] >= least]
        if left and not moved:
            more = -(-total // capacity)
            runs.append((capacity, opened, more))
            opened += more
    return np.array(sorted(moves), np.int64).reshape(-1, 5)


def _joined(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for gap, first, n in sorted(runs):
        if out and out[-1][0] == gap and out[-1][1] + out[-1][2] == first:
            out[-1] = (gap, out[-1][1], out[-1][2] + n)
        else:
            out.append((gap, first, n))
    return out


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces (``length`` from 1 to ``capacity``)."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves = plan(counts, capacity)
    base = dict(zip(sorted(counts), accumulate((counts[k] for k in sorted(counts)), initial=0)))
    starts = np.zeros(capacity + 1, np.int64)
    for length, before in base.items():
        starts[length] = before
    # The place of every move in the order of all pieces.
    at = starts[moves[:, 0]] + moves[:, 1]
    shared = found.sparkSession.sparkContext.broadcast((at, moves[:, 1:]))
    columns = found.columns
    hidden = {c: f"_{i}_piece" for i, c in enumerate(columns)}  # the ordinal brings columns of its own
    order = [hidden[c] for c in ("length", *(c for c in columns if c not in ("length", "ids")))]
    ranked = with_ordinal(found.withColumnsRenamed(hidden), order, name="_ord", staged=True, ties=True)
    ranked = ranked.withColumnsRenamed({v: k for k, v in hidden.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest = shared.value
        for batch in batches:
            ordinal = batch.column("_ord").to_numpy()
            own = np.searchsorted(at, ordinal, side="right") - 1
            out = {c: batch.column(c) for c in columns}
            out["sequence_id"] = rest[own, 2] + ordinal - at[own]
            out["offset"] = rest[own, 3]
            yield pa.record_batch(out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ranked.select(*columns, "_ord").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, model_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: ``sequence_id`` and ``offset``, without gaps from 0."""
    return place(cut_lineage(pieces(docs, model_file, capacity, with_ids), "pieces"), capacity)
