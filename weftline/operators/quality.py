"""Checks on rows, vectors and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as V


def require(df: DataFrame, predicate: Column, message: str | Column) -> DataFrame:
    """The same rows; evaluating a row that fails the predicate is an error."""
    text = F.lit(message) if isinstance(message, str) else message
    failed = ~F.coalesce(predicate, F.lit(False))
    return df.where(F.when(failed, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def vector_health(
    df: DataFrame, vector: str, by: Sequence[str] = (), lo: float = 0.0, hi: float = 1.0
) -> DataFrame:
    """Counts of NULL, bad (NaN, infinite), out-of-range and all-zero vectors."""
    v = F.col(vector)
    finite = F.filter(v, lambda x: ~V.is_bad(x))

    def count(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(v.isNull()).alias("n_null"),
        count(F.exists(v, lambda x: F.isnan(x))).alias("n_nan"),
        count(F.exists(v, lambda x: F.abs(x) == float("inf"))).alias("n_inf"),
        count((F.array_min(finite) < lo) | (F.array_max(finite) > hi)).alias("n_out_of_range"),
        count(V.all_zero(v)).alias("n_zero"),
        F.min(F.array_min(finite)).alias("min_value"),
        F.max(F.array_max(finite)).alias("max_value"),
    )


def zero_in_zero_out(df: DataFrame, given: str, result: str) -> DataFrame:
    """Rows whose input is all zero although their output is not."""
    return df.where(V.all_zero(given) & ~V.all_zero(result))


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how many keys have the same value, a changed one, or one side only."""
    left = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return left.join(right, key, "full").agg(
        F.count_if(both & same).alias("n_same"),
        F.count_if(both & ~same).alias("n_changed"),
        F.count_if(F.col("_in_b").isNull()).alias("n_only_left"),
        F.count_if(F.col("_in_a").isNull()).alias("n_only_right"),
    )


def shape_check(df: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """One row: rows, and per column the rows whose array has another size."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~F.size(c).eqNullSafe(F.lit(n))).alias(f"wrong_{c}") for c, n in sizes.items()],
    )


def corpus_profile(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Documents, characters and words with subtotals for each level of ``by``."""
    from ..functions.ids import words

    measured = df.select(
        *by, F.length(text).cast("bigint").alias("_chars"), F.size(words(text)).cast("bigint").alias("_words")
    )
    return measured.rollup(*by).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("_chars").alias("n_chars"),
        F.sum("_words").alias("n_words"),
        F.min("_chars").alias("min_chars"),
        F.max("_chars").alias("max_chars"),
        F.avg("_chars").alias("mean_chars"),
    )
