"""Column functions on ``ARRAY<FLOAT>`` and ``ARRAY<DOUBLE>`` vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .ids import _col

# Per-channel statistics of the video frame transform.
FRAME_MEAN = [0.43216, 0.394666, 0.37645]
FRAME_STD = [0.22803, 0.22145, 0.216989]


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def normalize_pixels(
    pixels: Column | str,
    channel: Column | str,
    mean: Sequence[float] = FRAME_MEAN,
    std: Sequence[float] = FRAME_STD,
    scale: float = 255.0,
) -> Column:
    """Scale to [0, 1], subtract the channel's mean, divide by its deviation.

    ``channel`` counts from 0.
    """
    at = _col(channel).cast("int") + 1
    m, s = F.element_at(_doubles(mean), at), F.element_at(_doubles(std), at)
    return F.transform(_col(pixels), lambda x: (x.cast("double") / F.lit(scale) - m) / s)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def is_bad(x: Column) -> Column:
    """NaN or infinite."""
    x = x.cast("double")
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def has_bad(vector: Column | str) -> Column:
    return F.exists(_col(vector), is_bad)


def all_zero(vector: Column | str) -> Column:
    return F.forall(_col(vector), lambda x: x == F.lit(0.0))


def flatten_nested(nested: Column | str, levels: int = 1) -> Column:
    out = _col(nested)
    for _ in range(levels):
        out = F.flatten(out)
    return out
