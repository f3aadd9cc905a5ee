"""Passages that several documents share, by a sparse suffix array.

A passage is repeated if ``min_words`` words in a row occur in at least two documents
(words as they are, whatever separates them). Only suffixes at content-selected positions
are kept: of the ``FIRST`` words at the beginning of a passage (all ``min_words`` if those are
fewer), the place of the smallest hash of ``GRAM`` words (a minimiser). Equal passages select
equal places, and at least ``min_words - FIRST + GRAM`` words follow there; ``min_words`` below
``GRAM`` are an error. Suffixes are sorted by these words;
each task sorts its own and hands on one row per different beginning, so a passage that
millions of documents share is a few rows, and the sorted runs are merged by range of the
key. Neighbours that agree and come from different documents are candidates; their
matches are then extended left and right to whole passages, which are compared once more.

The result has one row per longest run of repeated passages: ``doc_id``, ``start_word``,
``end_word``, ``start``, ``end`` (code points, end exclusive) and ``n_words``. Documents that
share nothing, short, empty and NULL texts have no row. Rows under one ``doc_id`` (or
without one) count as one document: what only they share is not repeated, and their spans are
those of each row, merged. An empty table gives an empty result. Words and runs of words
are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .words import Texts, slices, window_hash

MIN_WORDS = 50
FIRST = 34
GRAM = 8


def _prefix_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value among ``values[i : i + width]``, for every i."""
    best, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        n = len(best) - step
        later = best[step:] < best[:n]
        best, at = np.where(later, best[step:], best[:n]), np.where(later, at[step:], at[:n])
        size += step
    return at


class Anchors:
    """Of a slice of texts: every window of ``min_words`` words and its selected position."""

    def __init__(self, column: pa.Array, min_words: int):
        self.texts = texts = Texts(column)
        self.words = texts.word_hash()
        first = min(FIRST, min_words)
        self.after = min_words - first + GRAM
        owner = texts.word_text()
        n = len(self.words) - min_words + 1
        whole = owner[: max(n, 0)] == owner[min_words - 1 :] if n > 0 else np.empty(0, dtype=bool)
        #: First word of every window inside one text.
        self.window = np.flatnonzero(whole)
        if len(self.window):
            grams = window_hash(self.words, GRAM)
            self.anchor = _prefix_min(grams, first - GRAM + 1)[self.window]
        else:
            self.anchor = self.window
        self.owner = owner[self.window]
        self.first = texts.first[self.owner] if len(self.window) else self.window

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and word number of each selected suffix."""
        anchor, some = np.unique(self.anchor, return_index=True)
        if not len(anchor):
            return np.empty(0, np.uint64), anchor, anchor
        return window_hash(self.words, self.after)[anchor], self.owner[some], anchor - self.first[some]


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort the suffixes of each batch; one row per different one, with its first and last document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(first[1:], len(key)) - 1
        yield pa.record_batch({"key": key[first], "low": doc[first], "high": doc[last]})


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge rows in the order of ``key``: keys that come from different documents. The last key waits."""
    key, low, high = (np.empty(0, np.int64) for _ in range(3))
    for batch in batches:
        key, low, high = (np.append(old, batch.column(c).to_numpy()) for old, c in ((key, "key"), (low, "low"), (high, "high")))
        if not len(key):
            continue
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, low, high = key[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        shared = low[:-1] != high[:-1]
        yield pa.record_batch({"key": key[:-1][shared]})
        key, low, high = key[-1:], low[-1:], high[-1:]
    if len(key) and low[0] != high[0]:
        yield pa.record_batch({"key": key})


def _shared(rows: DataFrame) -> DataFrame:
    """Keys of ``rows`` (``key``, ``doc``) that occur in at least two documents."""
    runs = rows.select("key", "doc").mapInArrow(_sorted_runs, "key long, low long, high long")
    return runs.repartition("key").sortWithinPartitions("key").mapInArrow(_neighbours, "key long")


NO_ID = -(1 << 63)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans of ``docs`` (``doc_id`` long, ``text``) that other documents share; see the module."""
    if min_words < GRAM:
        raise ValueError(f"min_words is {min_words}, at least {GRAM} are needed")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key, owner, word = Anchors(part.column("text"), min_words).suffixes()
                doc = part.column("doc").to_numpy()[owner]
                yield pa.record_batch({"key": key.view(np.int64), "doc": doc, "word": word.astype(np.int32)})

    anchors = cut_lineage(texts.mapInArrow(select, "key long, doc long, word int"), "suffixes")
    candidates = anchors.join(_shared(anchors).hint("merge"), "key").groupBy("doc").agg(F.collect_set("word").alias("words"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = Anchors(part.column("text"), min_words)
                if not len(found.window):
                    continue
                wanted = part.column("words")
                n = pc.list_value_length(wanted).to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(n)), n)
                places = found.texts.first[text] + wanted.flatten().to_numpy()
                own = np.isin(found.anchor, places)
                window, owner, first = found.window[own], found.owner[own], found.first[own]
                key = window_hash(found.words, min_words)[window]
                points, border = found.texts.code_points(), found.texts.border
                start = points[found.texts.start[window]] - points[border[owner]]
                end = points[found.texts.end[window + min_words - 1]] - points[border[owner]]
                yield pa.record_batch(
                    {
                        "key": key.view(np.int64),
                        "doc": part.column("doc").to_numpy()[owner],
                        "place": (window - first) << 32 | start,
                        "size": (end - start).astype(np.int32),
                    }
                )

    whole = texts.join(candidates.hint("merge"), "doc").select("doc", "text", "words")
    # ``place`` is the number of the first word and its code point, so that rows stay narrow.
    windows = cut_lineage(whole.mapInArrow(extend, "key long, doc long, place long, size int"), "windows")
    moved = windows.join(_shared(windows).hint("merge"), "key").select("doc", "place", "size").repartition("doc")
    start = F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    repeated = moved.select("doc", F.shiftright("place", 32).alias("word"), start.alias("start"), (start + F.col("size")).alias("end"))
    by_place = Window.partitionBy("doc").orderBy("word", "end")
    apart = F.coalesce(F.col("word") > F.max("word").over(by_place.rowsBetween(Window.unboundedPreceding, -1)) + min_words, F.lit(True))
    runs = repeated.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc", "run").agg(
        F.min("word").cast("long").alias("start_word"),
        (F.max("word") + min_words).cast("long").alias("end_word"),
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
    )
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return spans.select(doc_id.alias("doc_id"), "start_word", "end_word", "start", "end", (F.col("end_word") - F.col("start_word")).alias("n_words"))
