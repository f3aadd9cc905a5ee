"""Alignment of two tokenizers over the same texts, and how well their vocabularies agree.

Both tokenizers encode a space and the text. Every token covers a range of bytes, so a text
has two ascending lists of token ends. Where a byte offset is in both lists, the tokens
since the last such offset form a group. A token of one and a token of the other are
linked if their ranges overlap. The lists are intersected by galloping: each end of the
shorter one is searched in the longer one from where the last was found, by steps that
double and then by bisection. The ranks so found give everything else: equal ends close a
group, and the tokens that overlap one of the shorter list lie between the ranks of
its two ends. Blocks of ``LANE`` ends, of all texts of a slice, gallop side by side.

A pair of ids counts the documents that hold it linked. The texts are tokenized once; what
is written of each document are its figures and its distinct linked pairs with their numbers
of links. Counts of pairs are summed per task before they are shuffled. Where the table of pairs
stays below a checked size every task looks its documents' pairs up in it; beyond
that the pairs are joined, those of many documents apart from the others.

NULL and empty texts, and texts that a tokenizer does not give back byte by byte, have no
tokens: zeros and an empty hash. Repeated rows count each for itself, also under one ``doc_id``
or NULL. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.lookup import lookup
from ..session import cut_lineage
from .parts import CACHE_CHARS, WIDE_SPACE, gather
from .words import SPACE, slices, sums

BATCH_BYTES = 2 << 20
CACHE = 200_000
LANE = 64
#: So many pairs of ids, at most, are broadcast (16 bytes each).
MAX_PAIRS = 4_000_000
#: So many pairs are counted at once in a task.
COUNT_AT_ONCE = 4 << 20

FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """The bytes of every id of a vocabulary."""

    def __init__(self, entries: dict[int, bytes]):
        listed = [entries.get(i, b"") for i in range(max(entries, default=-1) + 1)]
        self.border = np.cumsum([0, *map(len, listed)])
        self.length = np.diff(self.border)
        self.bytes = np.frombuffer(b"".join(listed), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.border, ids)[0]


def before_blanks(data: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Borders of parts that begin with a blank after a character that is no white space.

    Neither split pattern nor merges of pieces run across such a place, as no piece has
    a blank after another character.
    """
    n = len(data)
    solid = ~SPACE[data] & ((data < 0x1C) | (data > 0x1F))
    if WIDE_SPACE.search(data.tobytes()):
        solid &= data < 0x80
    cut = np.zeros(n, dtype=bool)
    cut[1:] = (data[1:] == 32) & solid[:-1]
    cut[border[(border > 0) & (border < n)]] = True
    return np.concatenate([[0], np.flatnonzero(cut), [n]]) if n else np.zeros(1, np.int64)


Encode = Callable[[list[str]], list[np.ndarray]]


def byte_level(model: str) -> tuple[Encode, Tokens]:
    """Encodes parts that begin with a blank; the bytes of the ids."""
    # Tasks share the cores already.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    tokenizer.encode_special_tokens = True
    byte = byte_of_char()
    added = {t["content"] for t in json.loads(model).get("added_tokens") or []}
    entries = {
        i: token.encode() if token in added else bytes(byte[c] for c in token) for token, i in tokenizer.get_vocab().items()
    }

    def make(parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    return make, Tokens(entries)


def pieces(model: bytes) -> tuple[Encode, Tokens]:
    """Encodes parts that begin with a blank; the bytes of the ids."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_proto=model)
    entries = {}
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            entries[i] = bytes([int(piece[3:-1], 16)])
        elif not (processor.is_control(i) or processor.is_unknown(i)):
            entries[i] = piece.replace("▁", " ").encode()
    blank = [processor.piece_to_id("▁")]

    def make(parts: list[str]) -> list[np.ndarray]:
        # The model itself puts a blank before a text, but not before an empty one.
        coded = processor.encode([part[1:] for part in parts], num_threads=1)
        return [np.array(ids if part != " " else blank, "<u4") for part, ids in zip(parts, coded)]

    return make, Tokens(entries)


class Both:
    """Both tokenizers of a worker, and the ids of parts it has seen: at most ``CACHE`` of at most ``CACHE_CHARS`` characters."""

    def __init__(self, first: str, second: bytes):
        (self.first, tokens_a), (self.second, tokens_b) = byte_level(first), pieces(second)
        self.tokens = [tokens_a, tokens_b]
        #: The number of ids of the first tokenizer, these, and those of the second.
        self.known: dict[str, bytes] = {}

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        return {
            part: np.array([len(a)], "<u4").tobytes() + a.tobytes() + b.tobytes()
            for part, a, b in zip(parts, self.first(parts), self.second(parts))
        }

    def encode(self, data: np.ndarray, border: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of all texts by both, and the borders of texts among them."""
        cuts = before_blanks(data, border)
        if len(cuts) < 2:
            return [np.empty(0, np.int64)] * 2, [np.zeros(len(border), np.int64)] * 2
        parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data))
        codes = parts.dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        made = self._new([part for part in distinct if part not in self.known])
        coded = [made[part] if part in made else self.known[part] for part in distinct]
        if len(self.known) + len(made) > CACHE:
            self.known.clear()
        self.known.update(islice(((m, v) for m, v in made.items() if len(m) <= CACHE_CHARS), CACHE))
        start = np.cumsum([0, *map(len, coded)]) // 4
        packed = np.frombuffer(b"".join(coded), "<u4")
        n_a = packed[start[:-1]].astype(np.int64)
        lengths = [n_a, np.diff(start) - 1 - n_a]
        kind = np.repeat(np.tile([2, 0, 1], len(coded)), np.stack([np.ones_like(n_a), *lengths], axis=1).ravel())
        at, which = np.searchsorted(cuts, border), codes.indices.to_numpy()
        out = [gather(packed[kind == i], np.cumsum(np.append(0, lengths[i])), which) for i in (0, 1)]
        return [ids.astype(np.int64) for ids, _ in out], [totals[at] for _, totals in out]


@cache
def _both(first: str, second: bytes) -> Both:
    return Both(first, second)


def search_on(ends: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first place from ``at`` on whose end is not below ``wanted``, for all lanes: doubling steps, then bisection.

    The last of ``ends`` must not be below any wanted one.
    """
    low, high = at, at.copy()
    active = np.flatnonzero(ends[high] < wanted)
    if not len(active):
        return high
    low, step = at.copy(), 1
    while len(active):
        low[active] = high[active] + 1
        high[active] = np.minimum(high[active] + step, len(ends) - 1)
        active = active[ends[high[active]] < wanted[active]]
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        less = ends[middle] < wanted[active]
        low[active] = np.where(less, middle + 1, low[active])
        high[active] = np.where(less, high[active], middle)
        active = active[low[active] < high[active]]
    return high


def gallop(short: np.ndarray, long: np.ndarray, from_: np.ndarray) -> np.ndarray:
    """For every end of ``short`` the first place in ``long`` whose end is not below it.

    Both are ascending; ``from_`` is a place for every end of ``short`` at or before the wanted one,
    which is used for the first of a lane only.
    """
    out = np.empty(len(short), np.int64)
    starts = np.arange(0, len(short), LANE)
    at = from_[starts]
    for k in range(min(LANE, len(short))):
        if starts[-1] + k >= len(short):
            starts, at = starts[:-1], at[:-1]
        at = search_on(long, short[starts + k], at)
        out[starts + k] = at
    return out


def overlaps(ends: tuple[np.ndarray, np.ndarray], border: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and group ends of the texts of a slice.

    ``ends`` are offsets over all texts one after the other, ``border`` the borders of texts among
    the tokens. Gives the places of linked tokens in both lists, and which tokens of each end a group.
    """
    n = [np.diff(b) for b in border]
    links: list[list[np.ndarray]] = [[], []]
    closes = [np.zeros(len(e), dtype=bool) for e in ends]
    for s in (0, 1):
        long = 1 - s
        # The first list drives where it is not longer.
        texts = n[0] <= n[1] if s == 0 else n[1] < n[0]
        if not texts.any():
            continue
        own = [np.flatnonzero(np.repeat(texts, n[i])) for i in (0, 1)]
        first = np.cumsum(n[long][texts]) - n[long][texts]
        short_ends, long_ends = ends[s][own[s]], ends[long][own[long]]
        if not len(short_ends):
            continue
        upto = gallop(short_ends, long_ends, np.repeat(first, n[s][texts]))
        equal = long_ends[upto] == short_ends
        closes[s][own[s][equal]] = True
        closes[long][own[long][upto[equal]]] = True
        # A token meets the others from the one after the rank of its start up to the rank of its end.
        since = np.append(0, (upto + equal)[:-1])
        count = upto - since + 1
        totals = np.cumsum(count)
        links[s].append(np.repeat(own[s], count))
        within = np.arange(totals[-1]) - np.repeat(totals - count, count)
        links[long].append(own[long][np.repeat(since, count) + within])
    a, b = (np.concatenate(part) if part else np.empty(0, np.int64) for part in links)
    return a, b, *closes


class Written:
    """The ids as decimal numbers, each with one more byte behind it for the mark that follows."""

    def __init__(self, n: int):
        self.border = np.cumsum([0, *(len(str(i)) + 1 for i in range(n))])
        self.bytes = np.frombuffer("".join(f"{i}," for i in range(n)).encode(), np.uint8)


@cache
def _written(n: int) -> Written:
    return Written(n)


def group_hashes(ids, border, closes, written: Written) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for every text; empty for texts without tokens."""
    group = [np.cumsum(c) - c for c in closes]
    last = [np.flatnonzero(c) + 1 for c in closes]
    # A group's tokens of the first list stand after all of the second list's groups before it.
    place = [np.arange(len(ids[0])) + np.append(0, last[1])[group[0]], np.arange(len(ids[1])) + last[0][group[1]]]
    order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    for at, values in zip(place, ids):
        order[at] = values
    data, totals = gather(written.bytes, written.border, order)
    data[totals[place[0][closes[0]] + 1] - 1] = ord("|")
    data[totals[place[1][closes[1]] + 1] - 1] = ord(";")
    cuts = totals[border[0] + border[1]]
    return [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(cuts, cuts[1:])]


def encode(texts: pa.Array, both: Both) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and borders of both tokenizers; texts that one of them does not give back have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(blank, texts, nothing))
    start = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[start[0] : start[-1]]
    start = start - start[0]
    size = np.diff(start)
    ids, border = both.encode(data, start)
    good = np.ones(len(size), dtype=bool)
    for tokens, found, cuts in zip(both.tokens, ids, border):
        same = sums(tokens.length[found], cuts) == size
        where = None if same.all() else np.flatnonzero(np.repeat(same, size))
        made = tokens.of(found if where is None else found[np.repeat(same, np.diff(cuts))])
        wrong = np.flatnonzero(made != (data if where is None else data[where]))
        good &= same
        good[np.searchsorted(start, wrong if where is None else where[wrong], "right") - 1] = False
    if not good.all():
        for i in (0, 1):
            n = np.diff(border[i])
            ids[i] = ids[i][np.repeat(good, n)]
            border[i] = np.cumsum(np.append(0, np.where(good, n, 0)))
    return ids, border


def aligned(docs: DataFrame, first: str, second: str) -> tuple[DataFrame, int, int]:
    """The written figures and linked pairs of every document, and the sizes of both vocabularies.

    A pair is ``a * (size of the second vocabulary) + b``; ``pairs`` are distinct and sorted, ``times`` their links.
    """
    with open(first) as f, open(second, "rb") as g:
        models = f.read(), g.read()
    n_a, n_b = (len(t.length) for t in _both(*models).tokens)
    wide = n_a * n_b >= 1 << 31
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _both(*shared.value)
        written = _written(max(n_a, n_b))
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                ids, border = encode(part.column("text"), both)
                ends = tuple(np.cumsum(t.length[i]) for t, i in zip(both.tokens, ids))
                a, b, *closes = overlaps(ends, border)
                text = np.repeat(np.arange(part.num_rows), np.diff(border[0]))[a]
                keys = text * (n_a * n_b) + ids[0][a] * n_b + ids[1][b]
                keys.sort()
                new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
                times = np.diff(np.append(new, len(keys)))
                keys = keys[new]
                cuts = np.searchsorted(keys, np.arange(part.num_rows + 1) * (n_a * n_b)).astype(np.int32)
                links = np.bincount(text, minlength=part.num_rows)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "row": part.column("row"),
                        "n_a": np.diff(border[0]),
                        "n_b": np.diff(border[1]),
                        "n_groups": sums(closes[0], border[0]),
                        "n_links": links.astype(np.int64),
                        "groups_sha256": group_hashes(ids, border, closes, written),
                        "pairs": pa.ListArray.from_arrays(cuts, (keys % (n_a * n_b)).astype(np.int64 if wide else np.int32)),
                        "times": pa.ListArray.from_arrays(cuts, times.astype(np.int32)),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    figures = ", ".join(f"{c} long" for c in FIGURES)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        run, f"doc_id {kind}, row long, {figures}, groups_sha256 string, pairs array<{'long' if wide else 'int'}>, times array<int>"
    )
    return cut_lineage(rows, "aligned"), n_a, n_b


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked), ``best``: no pair of the same first id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def put() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"pair": pair.astype(np.int64), "n": n.astype(np.int64)})

        for batch in batches:
            held.append(batch.column("pairs").flatten().to_numpy())
            size += len(held[-1])
            if size >= COUNT_AT_ONCE:
                yield put()
                held, size = [], 0
        if held:
            yield put()

    counts = rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # At most as many rows as the second vocabulary has ids.
    same_a = Window.partitionBy(F.expr(f"pair div {n_b}"))
    return cut_lineage(counts.withColumn("best", F.col("n") == F.max("n").over(same_a)), "pairs")


def align(docs: DataFrame, first: str, second: str, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``first`` is the file of a byte-level tokenizer (A), ``second`` that of a sentencepiece model (B).
    ``n_best`` are links of a pair that no other pair of its A id exceeds, ``count_sum`` sums the pairs' counts over links.
    """
    rows, _, n_b = aligned(docs, first, second)
    counts = pair_counts(rows, n_b)
    figures = ["doc_id", *FIGURES]
    if counts.count() <= max_pairs:
        return _looked_up(rows, counts).select(*figures, "n_best", "count_sum", "groups_sha256")
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair").withColumn("pair", F.col("pair").cast("long"))
    found = lookup(each, counts, "pair", "n", staged=True)
    per_row = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("bigint")
    return rows.join(per_row, "row", "left").select(
        *figures, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )


def _looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    table = counts.toArrow().sort_by("pair")
    shared = rows.sparkSession.sparkContext.broadcast(
        (table.column("pair").to_numpy(), table.column("n").to_numpy(), table.column("best").to_numpy())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            cuts = np.append(0, np.cumsum(pc.list_value_length(pairs).to_numpy()))
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            out = {c: batch.column(c) for c in ("doc_id", *FIGURES)}
            out["n_best"] = sums(np.where(best[at], times, 0), cuts)
            out["count_sum"] = sums(n[at] * times, cuts)
            yield pa.record_batch({**out, "groups_sha256": batch.column("groups_sha256")})

    kind = rows.schema["doc_id"].dataType.simpleString()
    figures = ", ".join(f"{c} long" for c in [*FIGURES, "n_best", "count_sum"])
    return rows.drop("row").mapInArrow(run, f"doc_id {kind}, {figures}, groups_sha256 string")
