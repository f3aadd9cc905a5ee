"""Ranked lexical search of many queries at once, with their common parts computed once.

A document scores with a query the sum, over the query's terms with repeats, of a weight of
the term times its saturated frequency in the document. Queries share terms, and often
whole sets of them. ``share`` mines such sets: the terms of every query are laid out by
the number of queries that hold them (terms of the same queries side by side), and the
most frequent neighbours become one node, again and again, until no two neighbours occur in
two queries. The nodes form a graph in which each stands for a set of terms that several queries
share. Over a block of documents every node has one row of partial scores, made once as the sum
of its two parts; a query adds the rows of the few nodes that it consists of.

Queries are taken in blocks of bounded size. For a block, the documents are read once: a row
becomes its length and its counts of the block's terms, in a written table, from which
document frequencies are summed. Scores are made from that table alone. A task keeps the ``k``
best documents of each query; the best of all tasks are ranked by Spark, per query. No pair of
a query and a document is ever a row unless it is among the best of its task.

Terms are known by 64-bit hashes of their bytes. NULL and empty texts and texts without a term
are no documents, and as queries find nothing. Repeated rows count as documents and queries
of their own. Equal scores are ordered by ``doc_id``, NULL last. Empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut_lineage
from .words import Texts, mix, slices

#: A block of queries ends at this number of them, or at this many bytes of their texts.
BLOCK_QUERIES = 4096
BLOCK_BYTES = 1 << 20
#: Bytes of partial scores held at once.
SCORE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20

OF_TERM = np.arange(256) >= 0x80
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    OF_TERM[_first : _last + 1] = True


@dataclass
class Block:
    """The queries of a block over one list of distinct terms (sorted hashes).

    ``query``, ``term``, ``times`` are the counts of terms per query, sorted by query.
    """

    terms: np.ndarray
    query: np.ndarray
    term: np.ndarray
    times: np.ndarray
    n_queries: int


def read_block(texts: list[str | None]) -> Block:
    found = Texts(pa.array(texts, pa.large_string()), lower=True, of_word=OF_TERM)
    terms, term = np.unique(found.word_hash(), return_inverse=True)
    pairs, times = np.unique(found.word_text() * len(terms) + term, return_counts=True)
    return Block(terms, pairs // max(len(terms), 1), pairs % max(len(terms), 1), times, len(texts))


@dataclass
class Sharing:
    """The graph of shared sums.

    The first nodes are the leaves: a term taken a number of times. Each level adds nodes,
    numbered on, that are the sum of two nodes of earlier levels. Query i adds the nodes
    ``nodes[border[i] : border[i + 1]]``.
    """

    leaf_term: np.ndarray
    leaf_times: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    nodes: np.ndarray
    border: np.ndarray

    @property
    def size(self) -> int:
        return len(self.leaf_term) + sum(len(left) for left, _ in self.levels)

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """Scores (query x document) from the parts (term x document)."""
        rows = np.empty((self.size, parts.shape[1]), np.int64)
        n = len(self.leaf_term)
        np.multiply(parts[self.leaf_term], self.leaf_times[:, None], out=rows[:n])
        for left, right in self.levels:
            np.add(rows[left], rows[right], out=rows[n : n + len(left)])
            n += len(left)
        out = np.zeros((len(self.border) - 1, parts.shape[1]), np.int64)
        some = np.flatnonzero(np.diff(self.border))
        if len(some):
            out[some] = np.add.reduceat(rows[self.nodes], self.border[some], axis=0)
        return out


def share(block: Block) -> Sharing:
    """Mine the shared sets of terms; the work of a round is in proportion to what the queries still hold."""
    kinds, leaf = np.unique(block.term << 32 | block.times, return_inverse=True)
    query = block.query
    held = np.bincount(leaf, minlength=len(kinds))
    #: Leaves of the same queries have the same sum.
    spread = np.zeros(len(kinds), np.uint64)
    np.add.at(spread, leaf, mix(query.astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((leaf, spread[leaf], -held[leaf], query))
    nodes, query = leaf[order], query[order]
    levels, total = [], len(kinds)
    while True:
        at = np.flatnonzero(query[1:] == query[:-1])
        pairs, which, counts = np.unique(nodes[at] << 32 | nodes[at + 1], return_inverse=True, return_counts=True)
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((pairs, counts))] = np.arange(1, len(pairs) + 1)
        rank[counts < 2] = 0
        strength = np.zeros(len(nodes) + 1, np.int64)
        strength[at] = rank[which]
        # Of neighbours that overlap, those of the more frequent pair.
        chosen = (strength[:-1] > 0) & (strength[:-1] > strength[1:]) & (strength[:-1] > np.append(0, strength[:-2]))
        place = np.flatnonzero(chosen[at])
        kept = np.bincount(which[place], minlength=len(pairs)) >= 2
        place = place[kept[which[place]]]
        if not len(place):
            break
        made, number = np.unique(which[place], return_inverse=True)
        levels.append((pairs[made] >> 32, pairs[made] & 0xFFFFFFFF))
        nodes[at[place]] = total + number
        total += len(made)
        rest = np.ones(len(nodes), dtype=bool)
        rest[at[place] + 1] = False
        nodes, query = nodes[rest], query[rest]
    border = np.searchsorted(query, np.arange(block.n_queries + 1))
    return Sharing(kinds >> 32, kinds & 0xFFFFFFFF, levels, nodes, border)


def postings(docs: DataFrame, block: Block) -> DataFrame:
    """Written table of the documents with a term: ``doc_id``, ``n``, and counts ``tfs`` of the block's ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = Texts(part.column("text"), lower=True, of_word=OF_TERM)
                n = np.diff(texts.first)
                some = np.flatnonzero(n)
                words = texts.word_hash()
                at = np.minimum(np.searchsorted(terms, words), max(len(terms) - 1, 0))
                hit = np.flatnonzero(terms[at] == words) if len(terms) else np.empty(0, np.int64)
                found, tfs = np.unique(texts.word_text()[hit] << 32 | at[hit], return_counts=True)
                border = np.append(np.searchsorted(found, some << 32), len(found)).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(some)),
                        "n": n[some],
                        "terms": pa.ListArray.from_arrays(border, (found & 0xFFFFFFFF).astype(np.int32)),
                        "tfs": pa.ListArray.from_arrays(border, tfs.astype(np.int64)),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")
    return cut_lineage(rows, "postings")


class Best:
    """The ``k`` best documents of every query so far."""

    def __init__(self, n_queries: int, k: int, kind: pa.DataType):
        self.k = k
        self.least = np.ones(n_queries, np.int64)
        self.held = pa.table({"query": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "doc_id": pa.array([], kind)})

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        query, doc = np.nonzero(scores >= self.least[:, None])
        if not len(query):
            return
        new = pa.table({"query": query.astype(np.int32), "score": scores[query, doc], "doc_id": ids.take(pa.array(doc))})
        both = pa.concat_tables([self.held, new])
        order = pc.sort_indices(both, [("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end")
        both = both.take(order)
        query = both.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.held = both.take(pa.array(np.flatnonzero(place < self.k)))
        full = np.flatnonzero(place == self.k - 1)
        # Equal scores may still win by their id.
        self.least[query[full]] = both.column("score").to_numpy()[full]


def _best(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """``query`` (number in the block), ``doc_id``, ``score``: the best of every task."""
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(total[0]), int(total[1])
    df = np.zeros(len(block.terms), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    sharing = share(block)
    shared = rows.sparkSession.sparkContext.broadcast((sharing, weight, len(block.terms), block.n_queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sharing, weight, n_block, n_queries = shared.value
        at_once = max(1, SCORE_BYTES // (8 * (n_block + sharing.size + len(sharing.nodes) + n_queries)))
        best = None
        for batch in batches:
            best = best or Best(n_queries, k, batch.schema.field("doc_id").type)
            for begin in range(0, batch.num_rows, at_once):
                part = batch.slice(begin, at_once)
                terms, tfs = part.column("terms"), part.column("tfs")
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(terms).to_numpy())
                term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
                m = 75 + (25 * part.column("n").to_numpy() * n_docs) // n_terms
                parts = np.zeros((n_block, part.num_rows), np.int64)
                parts[term, doc] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                best.add(sharing.scores(parts), part.column("doc_id"))
        if best is not None:
            yield from best.held.select(["query", "doc_id", "score"]).combine_chunks().to_batches()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"query int, doc_id {kind}, score long")


def blocks(queries: DataFrame) -> Iterator[list]:
    """The rows of ``queries`` in blocks, fetched one partition at a time."""
    held, size = [], 0
    for row in queries.select("item_id", "text").toLocalIterator():
        length = len((row["text"] or "").encode())
        if held and (len(held) >= BLOCK_QUERIES or size + length > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append(row)
        size += length
    if held:
        yield held


def rank(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the ``k`` best documents (score above 0) of each row of ``queries``."""
    spark = docs.sparkSession
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    named = StructType([StructField("query", IntegerType()), queries.schema["item_id"]])
    kinds = [f"item_id {queries.schema['item_id'].dataType.simpleString()}", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"]
    out = spark.createDataFrame([], f"{kinds[0]}, rank int, {kinds[1]}, score long")
    for rows in blocks(queries):
        block = read_block([row["text"] for row in rows])
        found = _best(postings(docs, block), block, k).withColumn("rank", place).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(rows)], named)
        out = out.unionByName(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out
