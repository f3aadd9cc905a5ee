"""Exact quantiles of very large groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .ordering import with_offsets


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """``by, q, quantile`` with linear interpolation between neighbours.

    Equal values are counted before anything is sorted, and the sorted values stay
    spread over key ranges: no group is gathered in one task.
    """
    if not by:
        one = df.withColumn("_all", F.lit(0))
        return exact_quantiles(one, ["_all"], value, qs).drop("_all")
    counts = cut_lineage(
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), "counts"
    )
    placed = with_offsets(
        counts, [*by, value], F.col("_n"), {f"_key_{k}": F.col(k) for k in by}, staged=True
    ).select(*by, value, "rel", "_n")
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    sizes = sizes.withColumnsRenamed({k: f"_size_{k}" for k in by})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_size_{k}")) for k in by])
    placed = placed.join(sizes, same).drop(*[f"_size_{k}" for k in by])
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in qs]))
    at = F.col("q") * (F.col("_total") - 1)
    below, above = F.floor(at), F.ceil(at)

    def holds(position):
        return (position >= F.col("rel")) & (position < F.col("rel") + F.col("_n"))

    hits = placed.withColumn("q", wanted).where(holds(below) | holds(above))
    low = F.max(F.when(holds(below), F.col(value)))
    high = F.max(F.when(holds(above), F.col(value)))
    share = F.max(at - below)
    return hits.groupBy(*by, "q").agg((low + (high - low) * share).alias("quantile"))
