"""Run metrics per time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def log_windows(
    sdf: DataFrame, window: str, delay: str, ts: str = "ts", value: str = "value", by: Sequence[str] = ()
) -> DataFrame:
    """Count, sum, least and greatest value per window; a window closes ``delay`` after its end."""
    return (
        sdf.withWatermark(ts, delay)
        .groupBy(F.window(ts, window), *by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(value).alias(f"sum_{value}"),
            F.min(value).alias(f"min_{value}"),
            F.max(value).alias(f"max_{value}"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *by, "n", f"sum_{value}", f"min_{value}", f"max_{value}",
        )
    )
