"""Byte-pair style merges over characters: training on word counts, encoding."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import FIRST_PAYLOAD_ID, words
from ..session import cut_lineage
from .vocabulary import int32_offsets, word_slices

# A word is kept as one string with every symbol between these two characters, so
# a merge is one string replacement and works from left to right.
OPEN, CLOSE = "\u0002", "\u0003"

CACHE, CACHE_CHARS = 200_000, 64

#: Bytes of words that are put into symbols at once; the arrays of a pass take about ten times as much.
SLICE_BYTES = 2 << 20

MERGES_PER_ROUND = 64
ROUNDS_PER_STAGE = 12


def _symbols(state: str) -> Column:
    inner = F.expr(f"substring({state}, 2, length({state}) - 2)")
    return F.split(inner, CLOSE + OPEN)


def _pairs(symbols: str, count: Column) -> Column:
    """``left, right, count`` of each two neighbours."""
    left = F.slice(symbols, 1, F.size(symbols) - 1)
    right = F.slice(symbols, 2, F.size(symbols) - 1)
    return F.zip_with(
        left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right"), count.alias("count"))
    )


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("left", "right").agg(F.sum("count").alias("count")).where(F.col("count") != 0)


def _merged(state: Column, merges: list) -> Column:
    for row in merges:
        pair = OPEN + row["left"] + CLOSE + OPEN + row["right"] + CLOSE
        state = F.replace(state, F.lit(pair), F.lit(OPEN + row["left"] + row["right"] + CLOSE))
    return state


def _independent(ranked: list, products: set[str], wanted: int) -> list:
    """The leading merges that later merges of the same round cannot change.

    A new pair made by a merge occurs at most as often as some pair that shares a
    symbol with the merge. While the accepted merges have no symbol in common, that
    pair ranks after all of them, so a strict drop in the count keeps the order
    that one merge per round would give.
    """
    taken, used = [], set()
    for i, row in enumerate(ranked[:wanted]):
        product = row["left"] + row["right"]
        if taken:
            following = ranked[i + 1]["count"] if i + 1 < len(ranked) else None
            if (
                {row["left"], row["right"]} & used
                or product in products
                or following is None
                or following >= row["count"]
            ):
                break
        taken.append(row)
        used |= {row["left"], row["right"], product}
        repeated = row["left"] == row["right"] or product in products
        products.add(product)
        if repeated:
            break
    return taken


def train_bpe(counts: DataFrame, n_merges: int) -> DataFrame:
    """``rank, left, right, count`` of the merges learned from ``token, count``.

    Merges the most frequent adjacent pair, ties by ``(left, right)``, again and
    again. Pair counts are kept as a table; a round only adds the differences of the
    words that its merges change. Only the leading pairs of a round reach the driver.
    """
    letters = F.regexp_replace("token", "(?s)(.)", OPEN + "$1" + CLOSE)
    # Words of one character never hold a pair.
    words = cut_lineage(
        counts.where(F.length("token") > 1).select("count", letters.alias("_state")), "words"
    )
    split = words.select("count", _symbols("_state").alias("_s"))
    pairs = cut_lineage(_summed(split.select(F.inline(_pairs("_s", F.col("count"))))), "pairs")
    merges, products, rounds = [], set(), 0
    while True:
        best = F.desc("count"), F.asc("left"), F.asc("right")
        ranked = _summed(pairs).orderBy(*best).limit(MERGES_PER_ROUND).collect()
        batch = _independent(ranked, products, n_merges - len(merges))
        for row in batch:
            merges.append((len(merges), row["left"], row["right"], row["count"]))
        if not batch or len(merges) >= n_merges:
            break
        # A word keeps its spelling, so a merge shows as fewer marks.
        changed = words.withColumn("_next", _merged(F.col("_state"), batch)).where(
            F.length("_next") < F.length("_state")
        )
        split = changed.select("count", _symbols("_state").alias("_s"), _symbols("_next").alias("_t"))
        moved = F.concat(_pairs("_s", -F.col("count")), _pairs("_t", F.col("count")))
        pairs = pairs.unionByName(cut_lineage(_summed(split.select(F.inline(moved))), "pairs"))
        words = words.withColumn("_state", _merged(F.col("_state"), batch))
        rounds += 1
        if rounds % ROUNDS_PER_STAGE == 0:
            words, pairs = cut_lineage(words, "words"), cut_lineage(_summed(pairs), "pairs")
    return counts.sparkSession.createDataFrame(
        merges, "rank int, left string, right string, count bigint"
    )


def _split(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """The symbols of one word after all merges, lowest rank first.

    A round merges every pair of the lowest rank from left to right. A text without spaces
    is one word: a heap of (rank, place) and links to both neighbours make its time follow
    its length, times a logarithm, and not its length times its merges.
    """
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(rank[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in rank]
    heapify(heap)
    while heap:
        lowest, touched = heap[0][0], []
        while heap and heap[0][0] == lowest:
            _, i = heappop(heap)
            j = after[i]
            # An entry is stale once either side has been merged.
            if parts[i] is None or j == len(parts) or rank.get((parts[i], parts[j])) != lowest:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            touched.append(i)
        # New pairs wait for the next round, even if their rank is lower.
        places = {i for i in touched if parts[i] is not None}
        places.update(before[i] for i in tuple(places) if before[i] >= 0)
        for i in places:
            found = rank.get((parts[i], parts[after[i]])) if after[i] < len(parts) else None
            if found is not None:
                heappush(heap, (found, i))
    return [part for part in parts if part is not None]


def symbol_vocab(counts: DataFrame, merges: DataFrame) -> DataFrame:
    """``symbol, id`` from 12 on: characters by frequency, ties by character, then merges by rank.

    A symbol that several merges make has the id of the first. The table has at most as many
    rows as there are characters, and merges.
    """
    chars = counts.select(F.explode(F.split("token", "")).alias("symbol"), "count").groupBy("symbol").agg(F.sum("count").alias("n"))
    first = F.struct(F.lit(0).alias("kind"), (-F.col("n")).alias("place"), F.col("symbol").alias("tie"))
    made = merges.select(
        F.concat("left", "right").alias("symbol"),
        F.struct(F.lit(1).alias("kind"), F.col("rank").cast("bigint").alias("place"), F.lit("").alias("tie")).alias("by"),
    )
    every = chars.select("symbol", first.alias("by")).unionByName(made).groupBy("symbol").agg(F.min("by").alias("by"))
    rank = F.row_number().over(Window.orderBy("by")) - 1
    return every.select("symbol", (rank + FIRST_PAYLOAD_ID).cast("int").alias("id"))


def _cached(code: Callable[[str], list[int]]) -> Callable[[str], bytes]:
    """``code`` of a word as 32-bit numbers; the last ``CACHE`` words of at most ``CACHE_CHARS`` are made once."""
    known: dict[str, bytes] = {}

    def get(word: str) -> bytes:
        found = known.get(word)
        if found is None:
            found = array("i", code(word)).tobytes()
            if len(word) <= CACHE_CHARS:
                if len(known) >= CACHE:
                    known.clear()
                known[word] = found
        return found

    return get


def _numbers(column: pa.Array, get: Callable[[str], bytes]) -> tuple[np.ndarray, pa.Array]:
    """Where the numbers of each row begin and end, and the numbers of all words of a slice."""
    coded = column.flatten().dictionary_encode()
    found = [get(word) for word in coded.dictionary.to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found], dtype=np.int64)])
    every = pa.array(np.frombuffer(b"".join(found), dtype=np.int32))
    numbers = pa.ListArray.from_arrays(pa.array(int32_offsets(ends)), every).take(coded.indices)
    by_word = np.concatenate([[0], np.cumsum(pc.list_value_length(numbers), dtype=np.int64)])
    n_words = pc.fill_null(pc.list_value_length(column), 0)
    return by_word[np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])], numbers.flatten()


def _lists(column: pa.Array, offsets: np.ndarray, values: pa.Array) -> pa.Array:
    missing = pa.array(np.asarray(column.is_null()))
    return pa.ListArray.from_arrays(pa.array(int32_offsets(offsets)), values, mask=missing)


def _broadcast_ranks(merges: DataFrame):
    """The merge list is a trained model, as long as the user asked for, and goes to every task."""
    listed = merges.select("rank", "left", "right").collect()
    return merges.sparkSession.sparkContext.broadcast({(r["left"], r["right"]): r["rank"] for r in listed})


def id_coder(counts: DataFrame, merges: DataFrame) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Two functions of a column of words: the ids of their symbols, and how many there are.

    Nothing is joined or shuffled: a Python worker splits a word where it meets it. A word with a
    character that ``counts`` lacks has no ids.
    """
    ranks = _broadcast_ranks(merges)
    # As many rows as there are characters and merges.
    listed = symbol_vocab(counts, merges).collect()
    vocab = counts.sparkSession.sparkContext.broadcast({r["symbol"]: r["id"] for r in listed})

    def coder() -> Callable[[str], bytes]:
        def code(word: str) -> list[int]:
            ids = [vocab.value.get(symbol) for symbol in _split(word, ranks.value)]
            return [] if None in ids else ids

        return _cached(code)

    @F.arrow_udf("array<int>")
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = coder()
        for column in columns:
            for part in word_slices(column, SLICE_BYTES):
                yield _lists(part, *_numbers(part, get))

    @F.arrow_udf("int")
    def n_ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = coder()
        for column in columns:
            for part in word_slices(column, SLICE_BYTES):
                sizes = int32_offsets(np.diff(_numbers(part, get)[0]))
                yield pa.array(sizes, mask=np.asarray(part.is_null()))

    return ids, n_ids


def encode_bpe_ids(df: DataFrame, counts: DataFrame, merges: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, input_ids``: the words of each document as the ids of their symbols."""
    ids, _ = id_coder(counts, merges)
    return df.select(key, ids(words(text)).alias("input_ids"))


def encode_bpe(df: DataFrame, words_col: str, merges: DataFrame, out: str = "symbols") -> DataFrame:
    """Add the symbols of all words of a row, in order, as one array.

    Nothing is shuffled; a Python worker merges each of the last ``CACHE`` distinct words once.
    """
    ranks = _broadcast_ranks(merges)

    @F.arrow_udf("array<string>")
    def apply_merges(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # As many symbols as there are characters and merges.
        place: dict[str, int] = {}
        get = _cached(lambda word: [place.setdefault(s, len(place)) for s in _split(word, ranks.value)])
        for column in columns:
            for part in word_slices(column, SLICE_BYTES):
                offsets, numbers = _numbers(part, get)
                yield _lists(part, offsets, pa.array(list(place), pa.string()).take(numbers))

    return df.withColumn(out, apply_merges(F.col(words_col)))
