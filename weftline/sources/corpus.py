"""Corpus scan, row slices, unions of shards and the sharded sink."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordering import with_ordinal

# A head of this size fits one task.
HEAD_ROWS = 10_000


def read_corpus(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, spread: bool = False
) -> DataFrame:
    """A parquet corpus; only the named columns are read.

    With ``spread`` a corpus with fewer splits than cores (a few files that cannot be
    split) is repartitioned, so that work on the texts uses all cores. A corpus of
    many splits is read in place, without a shuffle.
    """
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        df = df.repartition(2 * cores)
    return df


def split_slice(
    df: DataFrame,
    order: Sequence[str],
    start: float | None = None,
    stop: float | None = None,
    unit: str = "rows",
) -> DataFrame:
    """Rows ``[start:stop]`` in the given order; ``unit`` is ``rows`` or ``percent``.

    Percent bounds are rounded to the nearest row. A short head is a top-n query;
    any other slice uses the distributed ordinal.
    """
    if unit not in ("rows", "percent"):
        raise ValueError(f"unknown unit {unit!r}")
    if unit == "percent":
        total = df.count()

        def at(p: float) -> int:
            return math.floor(total * p / 100 + 0.5)

        start = None if start is None else at(start)
        stop = None if stop is None else at(stop)
    if not start and stop is not None and stop <= HEAD_ROWS:
        return df.orderBy(*order).limit(int(stop))
    keep = F.lit(True)
    if start:
        keep = keep & (F.col("_slice") >= int(start))
    if stop is not None:
        keep = keep & (F.col("_slice") < int(stop))
    return with_ordinal(df, order, "_slice").where(keep).drop("_slice")


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """All rows of all shards, duplicates kept; the schemas must agree."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), shards)


def with_shard(df: DataFrame, order: Sequence[str], n_shards: int = 5) -> DataFrame:
    """Add ``shard``: equal contiguous parts of the order, numbered from 0."""
    total = df.count()
    return with_ordinal(df, order, "_ord").withColumn(
        "shard", F.expr(f"cast(_ord * {int(n_shards)} div {max(total, 1)} as int)")
    ).drop("_ord")


def write_shards(df: DataFrame, path: str, order: Sequence[str], n_shards: int = 5) -> None:
    """Write contiguous shards as directories ``shard=0`` ... of one parquet table."""
    with_shard(df, order, n_shards).write.partitionBy("shard").parquet(path)
