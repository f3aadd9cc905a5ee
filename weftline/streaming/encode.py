"""Encode arriving documents with the batch column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import ids as I


def encode_stream(
    sdf: DataFrame, text: str = "text", max_len: int | None = None, media: Sequence[str] = ()
) -> DataFrame:
    """Replace ``text`` by ``input_ids`` and ``attention_mask``; works on batches too."""
    source = F.col(text)
    if max_len is not None:
        # A character has one byte at least, so what is cut off here could not stay.
        source = F.substring(source, 1, max_len)
    ids = I.append_eos(I.byte_ids(source))
    if max_len is not None:
        ids = I.truncate(I.add_bos(ids), max_len)
    if media:
        ids = I.splice_after_first(ids, I.markers(media))
    return sdf.withColumn("input_ids", ids).withColumn(
        "attention_mask", I.ones_like(F.col("input_ids"))
    ).drop(text)
