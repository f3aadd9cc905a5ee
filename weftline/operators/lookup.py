"""Equi-joins from many rows to a keyed table when few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

HEAD_ROWS = 50_000
HEAD_BYTES = 64 << 20

_DIGEST = ("_d1", "_d2")


def _digests(key: str) -> list[Column]:
    """Two 64-bit hashes; NULL for a NULL key."""
    seeds = [F.xxhash64(key), F.xxhash64(F.lit("second"), F.col(key))]
    return [F.when(F.col(key).isNotNull(), d).alias(name) for name, d in zip(_DIGEST, seeds)]


def head_of(table: DataFrame, key: str, weight: str, head_rows: int = HEAD_ROWS) -> DataFrame:
    """The heaviest rows of ``table``: digests of the key, and all other columns.

    At most ``head_rows`` rows, and of these the first ``HEAD_BYTES`` bytes of values.
    """
    values = [c for c in table.columns if c != key]
    top = table.orderBy(F.desc(weight), *_digests(key)).limit(head_rows)
    top = top.select(*_digests(key), *values, F.length(F.to_json(F.struct(*values))).alias("_bytes"))
    upto = Window.orderBy(F.desc(weight), *_DIGEST).rowsBetween(Window.unboundedPreceding, 0)
    sized = top.withColumn("_all_bytes", F.sum(F.col("_bytes") + 16).over(upto))
    return sized.where(F.col("_all_bytes") <= HEAD_BYTES).drop("_bytes", "_all_bytes")


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    head_rows: int = HEAD_ROWS,
    staged: bool = False,
) -> DataFrame:
    """Left join of ``rows`` to ``table`` (unique ``key``), safe against hot keys.

    The heaviest keys of ``table`` are broadcast, as 128-bit digests, so that a hot key of any
    length is one of them (``head_of`` bounds their number and bytes). Rows of all other keys take a
    shuffled join, and none of those keys is frequent. ``staged`` says that ``table`` is
    already a written table, cheap to read again.
    """
    if not staged:
        table = cut_lineage(table, "lookup")
    head = cut_lineage(head_of(table, key, weight, head_rows), "head")
    marked = rows.withColumns(dict(zip(_DIGEST, _digests(key))))
    if table.count() <= head.count():
        return marked.join(F.broadcast(head), list(_DIGEST), "left").drop(*_DIGEST)
    known = F.broadcast(head.select(*_DIGEST, F.lit(True).alias("_known")))
    tail = table.withColumns(dict(zip(_DIGEST, _digests(key)))).join(known, list(_DIGEST), "left_anti").drop(*_DIGEST)
    found = marked.join(F.broadcast(head.withColumn("_known", F.lit(True))), list(_DIGEST), "left")
    # Rows without a key find nothing; they must not meet in one shuffle partition.
    done = found.where(F.col("_known").isNotNull() | F.col(key).isNull()).drop("_known", *_DIGEST)
    rest = marked.where(F.col(key).isNotNull()).join(known, list(_DIGEST), "left_anti").drop(*_DIGEST)
    return done.unionByName(rest.join(tail, key, "left"))
