"""Put the modalities of one sample side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _as_struct(df: DataFrame, on: str, name: str) -> DataFrame:
    """One row per key with the other columns in one struct; a second row is an error."""
    rest = [c for c in df.columns if c != on]
    once = df.groupBy(on).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias(name))
    return once.select(
        on,
        F.when(F.col("_n") == 1, F.col(name))
        .otherwise(F.raise_error(F.concat(F.lit(f"more than one {name} for sample "), F.col(on).cast("string"))))
        .alias(name),
    )


def assemble(
    text: DataFrame,
    images: DataFrame | None = None,
    audios: DataFrame | None = None,
    videos: DataFrame | None = None,
    on: str = "sample_id",
) -> DataFrame:
    """Left-join the given modalities to the text by sample key.

    A modality that is not given adds no join; a sample without a row in a given
    modality has NULL there.
    """
    out = text
    for name, df in (("image", images), ("audio", audios), ("video", videos)):
        if df is not None:
            out = out.join(_as_struct(df, on, name), on, "left")
    return out
