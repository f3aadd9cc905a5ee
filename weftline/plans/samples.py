"""From texts with media to encoded samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import ids as I
from ..operators.sequences import batch_longest, encode_sample, slot_layout
from .presets import PRESETS


def text_ids(df: DataFrame, text: str, max_len: int, out: str = "input_ids") -> DataFrame:
    """``<s>``, the bytes of the text, ``<eos>``, cut to ``max_len``.

    A character is at least one byte, so only the first ``max_len`` characters can
    reach the result; the others are not tokenized.
    """
    ids = I.byte_ids(F.substring(text, 1, max_len))
    return df.withColumn(out, I.truncate(I.add_bos(I.append_eos(ids)), max_len))


def prepare_samples(
    df: DataFrame,
    preset: str,
    text: str = "target_text",
    batch_col: str = "batch_id",
    features: Mapping[str, str] | None = None,
    enabled: Sequence[str] | None = None,
) -> DataFrame:
    """Encoded samples of a preset: tokens with markers, labels, mask, media."""
    p = PRESETS[preset]
    # Later characters are cut off anyway (see ``text_ids``), so they are not shuffled.
    df = df.withColumn(text, F.substring(text, 1, p.max_len))
    length = F.least(I.byte_count(text) + 2, F.lit(p.max_len))
    placed = batch_longest(df, batch_col, length, "_longest")
    padded = (
        text_ids(placed, text, p.max_len)
        .withColumn("input_ids", I.pad_to("input_ids", F.col("_longest")))
        .drop("_longest")
    )
    return encode_sample(padded, "input_ids", p.media, p.prefix, features=features, enabled=enabled).drop(text)


def sample_layout(df: DataFrame, preset: str, key: str, tokens: str = "text_tokens") -> DataFrame:
    """Input positions of encoded samples, with the preset's feature slots.

    In a preset with optional media, a sample without a medium has no slots for it;
    the media columns carry the plural names of ``encode_sample``.
    """
    p = PRESETS[preset]
    slots = [
        (kind, n, F.col(f"{kind}s").isNotNull() if p.optional and f"{kind}s" in df.columns else None)
        for kind, n in p.slots
    ]
    return slot_layout(df, tokens, p.cut, slots, key)
