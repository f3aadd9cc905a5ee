"""Near duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A document's set are its distinct shingles of ``shingle`` words (fewer words: the whole
sequence as one; A-Z in lower case). A signature keeps 16 bits of each of ``n_hashes``
minima. Two sets of similarity s differ in each symbol with probability 1 - s at most, so
``radius`` is chosen such that a pair at the threshold differs in more symbols with a
probability below ``miss``.

All pairs of signatures within the radius are found: the symbols are cut into chunks, of
which one has at most one error by the pigeonhole principle. A signature has one key for
each way to leave out one symbol of a chunk; signatures that share a key are candidates.
Equal sets are one node before that, so copies never meet.

Links are confirmed on the full sets. A group of near copies must not become all its pairs,
and only components are asked for: the smallest node of a key is its pivot, and every node is
compared with the closest pivot of its keys first. Only where a key still joins different
components do signatures meet pair by pair across components, large groups in blocks, and
pairs within the radius are confirmed. So no pair within the radius is left out unless both
ends are already connected.

Shingles and sets are known by 64-bit hashes. NULL and empty texts have no set and are
linked with nothing; each such row, also without ``doc_id``, is its own component. Rows with
equal sets are one component, also when repeated under one ``doc_id``; a component whose
rows all lack a ``doc_id`` has none. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import cut_lineage
from .exact import fresh
from .words import Texts, mix, slices, window_hash

BLOCK = 256


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 80
    n_hashes: int = 96
    miss: float = 1e-6

    @property
    def radius(self) -> int:
        """The fewest errors that a pair at the threshold exceeds with a probability below ``miss``."""
        p, n, tail = 1 - self.percent / 100, self.n_hashes, 1.0
        for r in range(n + 1):
            tail -= comb(n, r) * p**r * (1 - p) ** (n - r)
            if tail <= self.miss:
                return r
        return n

    @property
    def chunks(self) -> tuple[np.ndarray, int]:
        """Chunk of each symbol, and how many chunks at the end may have no error.

        Errors allowed per chunk, plus one each, add up to ``radius + 1``: more errors than
        allowed in every chunk would be more than ``radius``.
        """
        exact = (self.radius + 1) % 2
        count = (self.radius + 1) // 2 + exact
        return np.concatenate([np.full(len(c), i) for i, c in enumerate(np.array_split(np.arange(self.n_hashes), count))]), exact


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7919).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and the border of each text."""
    texts = Texts(column, lower=True)
    words, first = texts.word_hash(), texts.first
    n_words = np.diff(first)
    grams = window_hash(words, k)
    n_grams = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    border = np.append(0, np.cumsum(n_grams))
    out = np.empty(border[-1], np.uint64)
    distinct = np.empty(len(out), dtype=bool)
    for i in np.flatnonzero(n_grams):
        a, b = border[i], border[i + 1]
        if n_words[i] >= k:
            out[a:b] = grams[first[i] : first[i] + b - a]
            out[a:b].sort()
        else:
            out[a] = window_hash(words[first[i] : first[i + 1]], n_words[i])[0] ^ np.uint64(n_words[i])
    distinct[1:] = out[1:] != out[:-1]
    distinct[border[:-1][n_grams > 0]] = True
    totals = np.append(0, np.cumsum(distinct))
    return out[distinct], totals[border]


def set_ids(sets: np.ndarray, border: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set (0 for an empty one)."""
    running = np.append(np.zeros(1, np.uint64), np.cumsum(mix(sets)))
    total = running[border[1:]] - running[border[:-1]]
    return np.where(np.diff(border) > 0, mix(total + np.diff(border).astype(np.uint64)), 0)


def signatures(sets: np.ndarray, border: np.ndarray, n_hashes: int) -> np.ndarray:
    """16 bits of each minimum; one row per set, zeros for an empty one."""
    out = np.zeros((len(border) - 1, n_hashes), np.uint16)
    filled = np.flatnonzero(np.diff(border))
    if len(filled):
        for i, a in enumerate(_multipliers(n_hashes)):
            out[filled, i] = (np.minimum.reduceat(sets * a, border[filled]) >> np.uint64(24)).astype(np.uint16)
    return out


def keys(signature: np.ndarray, params: Params) -> np.ndarray:
    """The keys of each signature, one row each: equal keys mean equal chunks but for one place."""
    chunk, exact = params.chunks
    place = np.arange(signature.shape[1], dtype=np.uint64)
    u = mix((signature.astype(np.uint64) << np.uint64(16)) + place + np.uint64(1))
    starts = np.flatnonzero(np.append(True, np.diff(chunk) > 0))
    sums = np.add.reduceat(u, starts, axis=1)
    last = starts[-1] if exact else signature.shape[1]
    without = mix(sums[:, chunk[:last]] - u[:, :last] + place[:last] * np.uint64(0x9E3779B97F4A7C15))
    if not exact:
        return without
    return np.concatenate([without, mix(sums[:, -1:] + np.uint64(0xD6E8FEB86659FD93))], axis=1)


def _documents(docs: DataFrame, params: Params) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``node`` (NULL without a set), ``signature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, border = shingle_sets(part.column("text"), params.shingle)
                sign = signatures(sets, border, params.n_hashes)
                empty = np.diff(border) == 0
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_shingles": np.diff(border),
                        "node": pa.array(set_ids(sets, border).view(np.int64), mask=empty),
                        "signature": pa.array([s.tobytes() for s in sign], pa.binary(), mask=empty),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, signature binary")


def _shared_keys(nodes: DataFrame, params: Params) -> DataFrame:
    """``key``, ``node`` of all keys that several nodes have, with the smallest node as ``pivot``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sign = _matrix(batch.column("signature"))
                found = keys(sign, params)
                node = batch.column("node").to_numpy()
                yield pa.record_batch({"key": found.ravel().view(np.int64), "node": np.repeat(node, found.shape[1])})

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one key lie together; the last row waits for the next batch."""
        key, node = np.empty(0, np.int64), np.empty(0, np.int64)
        pivot, same = 0, False  # of the row that waits: smallest node of its key, is it not the first

        def emit(upto: int, key, node, pivot, same):
            first = np.append(not same, key[1:] != key[:-1])
            began = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            low = np.where((began == 0) & same, pivot, node[began])
            shared = ~first
            shared[:-1] |= ~first[1:]
            rows = np.flatnonzero(shared[:upto])
            batch = pa.record_batch({"key": key[rows], "node": node[rows], "pivot": low[rows]})
            return batch, low, first

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.append(key, batch.column("key").to_numpy())
            node = np.append(node, batch.column("node").to_numpy())
            out, low, first = emit(len(key) - 1, key, node, pivot, same)
            yield out
            key, node, pivot, same = key[-1:], node[-1:], low[-1], not first[-1]
        if len(key):
            yield emit(1, key, node, pivot, same)[0]

    all_keys = nodes.select("node", "signature").mapInArrow(spread, "key long, node long")
    return all_keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(runs, "key long, node long, pivot long")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(n, -1)


def _distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) with ``far``, the number of symbols in which their signatures differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = (_matrix(batch.column("sa")) != _matrix(batch.column("sb"))).sum(axis=1)
                yield batch.select(["a", "b"]).append_column("far", pa.array(far.astype(np.int32)))

    sign = nodes.select("node", "signature")
    both = pairs.join(sign.toDF("a", "sa"), "a").join(sign.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, far int")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``node``, ``shingles`` of the wanted nodes (``node``, ``low``), made again from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, border = shingle_sets(part.column("text"), k)
                own = set_ids(sets, border).view(np.int64) == part.column("node").to_numpy()
                rows = np.flatnonzero(own)
                data = [sets[border[i] : border[i + 1]].tobytes() for i in rows]
                yield pa.record_batch({"node": part.column("node").take(pa.array(rows)), "shingles": pa.array(data, pa.binary())})

    # One plan at every size: texts move once, however few nodes are wanted.
    same = F.col("doc_id").eqNullSafe(F.col("low"))
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), same).select("node", "text")
    return texts.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array([_similar(x, y, percent) for x, y in sides], pa.bool_()))

    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` of all nodes of ``edges`` (``a``, ``b``): the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label's own
    label, so the number of rounds follows the logarithm of the longest path.
    """
    both = cut_lineage(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.toDF("b", "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        lower = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.toDF("label", "next")
        moved = lower.join(jump, "label").select("node", "old", F.least("label", "next").alias("label"))
        moved = cut_lineage(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def _across(shared: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """Links (``a``, ``b``) between different components that share a key.

    A key of few nodes gives its pairs from different components. Keys of many nodes are
    put together to clusters, so that a large group of near copies, which shares many keys, is
    compared once; its signatures and sets meet in blocks, and only links come out.
    """
    members = shared.select("key", "node", "pivot").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_key = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = members.join(per_key.where("low <> high").select("key", "n"), "key")
    mixed = cut_lineage(mixed, "mixed")
    large = mixed.where(F.col("n") > BLOCK)
    few = mixed.where(F.col("n") <= BLOCK).select("key", "node", "label")
    if large.isEmpty():
        clusters = labels.limit(0).toDF("node", "cluster")
        links = shared.limit(0).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    else:
        clusters = components(large.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()).toDF("node", "cluster")
        clusters = cut_lineage(clusters, "clusters")
        grouped = clusters.join(labels, "node", "left").select("cluster", "node", F.coalesce("label", "node").alias("label"))
        links = _in_blocks(grouped, nodes.select("node", "signature").join(sets, "node"), params)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cell in _whole_cells(batches, ["key"]):
            node, label, cluster = (rows.column(c).to_numpy() for c in ("node", "label", "cluster"))
            for x, y in _meetings(cell):
                meet = (label[x] != label[y]) & ((cluster[x] != cluster[y]) | (cluster[x] == 0))
                a, b = node[x[meet]], node[y[meet]]
                yield pa.record_batch({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    # Nodes of one cluster have met already; 0 is no cluster.
    few = few.join(clusters, "node", "left").select("key", "node", "label", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    met = few.repartition("key").sortWithinPartitions("key").mapInArrow(pairs, "a long, b long").distinct()
    near = _distances(met, nodes).where(F.col("far") <= params.radius).select("a", "b")
    return _confirmed(near, sets, params.percent).union(links.select("a", "b"))


def _in_blocks(members: DataFrame, content: DataFrame, params: Params) -> DataFrame:
    """Links (``a``, ``b``) between different labels of a cluster (``cluster``, ``node``, ``label``).

    The largest component is not compared with itself; all others are compared with it
    and with each other, in blocks of about ``BLOCK`` nodes a side.
    """
    per_part = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    per_cluster = per_part.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("largest"), F.sum("n").alias("n"))
    per_cluster = per_cluster.where("n > largest.n").select(
        "cluster",
        F.col("largest.label").alias("main"),
        F.ceil(F.col("largest.n") / BLOCK).alias("mains"),
        F.ceil((F.col("n") - F.col("largest.n")) / BLOCK).alias("rests"),
    )
    rows = members.join(per_cluster, "cluster").withColumn("is_main", F.col("label") == F.col("main"))
    number = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests")))
    # Blocks of the largest part are -1, -2, ... and meet every block 0, 1, ... of the rest; those meet each other.
    rows = rows.withColumn("block", F.when(F.col("is_main"), -1 - number).otherwise(number))
    block = F.col("block")
    with_rest = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("rests") - 1),
        lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")),
    )
    with_main = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("mains") - 1), lambda i: F.struct((-1 - i).alias("i"), block.alias("j"))
    )
    meets = F.when(F.col("is_main"), with_rest).otherwise(F.concat(with_rest, with_main))
    cells = rows.select("cluster", "node", "label", "block", F.explode(meets).alias("cell"))
    cells = cells.join(content, "node").select("cluster", "cell.i", "cell.j", "node", "label", "block", "signature", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cell in _whole_cells(batches, ["cluster", "i", "j"]):
            sign, shingles = _matrix(rows.column("signature")), rows.column("shingles").to_pylist()
            node, label, block = (rows.column(c).to_numpy() for c in ("node", "label", "block"))
            within = rows.column("i").to_numpy() == rows.column("j").to_numpy()
            joined = _Joined()
            for x, y in _meetings(cell):
                meet = (label[x] != label[y]) & (within[x] | (block[x] != block[y]))
                x, y = x[meet], y[meet]
                near = (sign[x] != sign[y]).sum(axis=1) <= params.radius
                for i, j in zip(x[near].tolist(), y[near].tolist()):
                    # One link is enough between components that these rows have connected already.
                    if joined.apart(label[i], label[j]) and _similar(shingles[i], shingles[j], params.percent):
                        joined.join(label[i], label[j])
                        yield pa.record_batch({"a": node[[i]], "b": node[[j]]})

    cells = cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return cells.mapInArrow(compare, "a long, b long")


class _Joined:
    """Labels that links have connected so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, label: int) -> int:
        while (up := self.above.get(label, label)) != label:
            self.above[label] = self.above.get(up, up)
            label = up
        return label

    def apart(self, x: int, y: int) -> bool:
        return self.root(x) != self.root(y)

    def join(self, x: int, y: int) -> None:
        self.above[self.root(x)] = self.root(y)


def _whole_cells(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``by``, no cell cut in two, with a number per cell; the last cell of a batch waits."""
    waiting: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        cell = _cells(rows, by)
        last = int(np.searchsorted(cell, cell[-1]))
        waiting = rows.slice(last)
        if last:
            yield rows.slice(0, last), cell[:last]
    if waiting is not None:
        yield waiting, _cells(waiting, by)


def _cells(rows: pa.Table, by: list[str]) -> np.ndarray:
    """A number per cell, rising along the sorted rows."""
    changes = np.zeros(rows.num_rows, dtype=bool)
    for part in (rows.column(c).to_numpy() for c in by):
        changes[1:] |= part[1:] != part[:-1]
    return np.cumsum(changes)


def _meetings(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every two rows of a cell meet once: rows and the rows that lie 1, 2, ... places behind them."""
    end = np.searchsorted(cell, cell, side="right")
    at, step = np.arange(len(cell)), 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            return
        yield at, at + step
        step += 1


def near_dedup(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``n_shingles``, ``node``, ``component_id``, ``kept``.

    ``component_id`` is the smallest ``doc_id`` of the row's component.
    """
    rows = cut_lineage(_documents(docs, params), "signatures")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.first("signature").alias("signature"))
    nodes = cut_lineage(nodes, "nodes")
    shared = cut_lineage(_shared_keys(nodes, params), "keys")
    members = shared.select("node").distinct()
    sets = cut_lineage(_full_sets(docs, nodes.select("node", "low").join(members, "node"), params.shingle), "sets")

    # Every node is compared with the closest of the pivots of its keys.
    stars = shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    closest = _distances(stars, nodes).where(F.col("far") <= params.radius).groupBy("b").agg(F.min(F.struct("far", "a")).alias("best"))
    linked = cut_lineage(_confirmed(closest.select(F.col("best.a").alias("a"), "b"), sets, params.percent), "links")
    labels = components(linked)
    found = _across(shared, labels, nodes, sets, params)
    of_a, of_b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    lifted = found.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(lifted)
    final = labels.select("node", "label").join(merged.toDF("label", "last"), "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    lone = merged.join(labels.select("node"), "node", "left_anti")
    final = final.unionByName(lone)

    known = nodes.select("node", "low").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = known.groupBy("label").agg(F.min(F.struct(F.col("low").isNull(), "low", "node")).alias("lowest"))
    known = known.join(lowest, "label").select("node", F.col("lowest.low").alias("component_id"), F.col("lowest.node").alias("keep_node"))
    out = rows.select("doc_id", "n_shingles", "node").join(known, "node", "left")
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component) & (alone | (F.col("node") == F.col("keep_node")))
    return out.select("doc_id", "n_shingles", "node", component.alias("component_id"), kept.alias("kept"))


def keep(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row of each component of ``docs``, and all rows without a set, with all their columns."""
    kept = near_dedup(docs, params).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("node").alias("_kept_node"))
    name, text = fresh(docs, "_node"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, border = shingle_sets(part.column(text), params.shingle)
                node = pa.array(set_ids(sets, border).view(np.int64), mask=np.diff(border) == 0)
                yield part.append_column(name, node)

    rows = docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.LongType())]))
    same = rows["doc_id"].eqNullSafe(kept["_kept_id"]) & rows[name].eqNullSafe(kept["_kept_node"])
    rows = rows.join(kept, same, "left_semi")
    place = fresh(docs, "_place")
    among = Window.partitionBy("doc_id", name).orderBy("text")
    return rows.withColumn(place, F.row_number().over(among)).where(F.col(name).isNull() | (F.col(place) == 1)).drop(name, place)
