"""Encoded samples: budgets, padding, markers, masks, feature slots, interleaving."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ids as I
from .packing import pack_by_key


def length_budget(
    df: DataFrame,
    ids: str = "input_ids",
    ctx: int = 2048,
    slots: int = 64,
    markers: int = 2,
    length: Column | None = None,
) -> DataFrame:
    """Add ``n_ids``, ``total_len`` (with markers and feature slots) and ``fits``.

    ``length`` gives the number of ids where they are not built yet.
    """
    n_ids = (F.size(ids) if length is None else length).cast("int")
    total = n_ids + F.lit(slots + markers)
    return df.withColumns({"n_ids": n_ids, "total_len": total, "fits": total <= F.lit(ctx)})


def batch_longest(df: DataFrame, batch_col: str, length: Column, out: str = "longest") -> DataFrame:
    """Add the greatest length in the row's batch.

    Call it on the texts: lengths are enough here, and texts are shorter to shuffle
    than ids. A batch is as large as the loader made it, never a share of the table.
    """
    return df.withColumn(out, F.max(length).over(Window.partitionBy(batch_col)))


def pad_batch(df: DataFrame, batch_col: str, ids: str = "input_ids", pad_id: int = I.PAD) -> DataFrame:
    """Right-pad each row to the longest row of its batch."""
    return (
        batch_longest(df, batch_col, F.size(ids), "_longest")
        .withColumn(ids, I.pad_to(ids, F.col("_longest"), pad_id))
        .drop("_longest")
    )


def has_modality(modality: str, enabled: Sequence[str], column: str | None = None) -> Column:
    """The modality is enabled and the sample has it.

    For a modality that is not enabled this is the constant false, so Catalyst
    removes the branch that depends on it.
    """
    if modality not in enabled:
        return F.lit(False)
    return F.col(column or modality).isNotNull()


def encode_sample(
    df: DataFrame,
    ids: str,
    media: Sequence[str],
    prefix: int = 64,
    pad_id: int = I.PAD,
    features: Mapping[str, str] | None = None,
    enabled: Sequence[str] | None = None,
) -> DataFrame:
    """Replace ``ids`` (padded) by ``text_tokens, labels, attention_mask`` and media.

    ``features`` maps a modality to its feature column; the output column gets the
    plural name and is NULL where the modality is off or the sample lacks it.
    """
    enabled = media if enabled is None else enabled
    tokens = I.splice_after_first(ids, I.markers(media))
    out = df.withColumns({"text_tokens": tokens, "labels": F.col(ids)})
    out = out.withColumn("attention_mask", I.attention_mask("text_tokens", pad_id, prefix))
    extra = {
        f"{m}s": F.when(has_modality(m, enabled, column), F.col(column))
        for m, column in (features or {}).items()
    }
    used = [c for c in {ids, *(features or {}).values()} if c not in extra]
    return out.withColumns(extra).drop(*used) if extra else out.drop(*used)


def slot_layout(
    df: DataFrame, ids: str, cut: int, slots: Sequence[tuple[str, int, Column | None]], key: str
) -> DataFrame:
    """One row per input position: ``key, pos, kind, src_pos``.

    The sequence is cut at ``cut`` and the feature slots go in between. A slot entry
    is ``(kind, n, present)``; with ``present`` the slots exist only in rows where
    that condition holds.
    """
    n = F.size(ids)

    def span(kind: str, first: Column, count: Column) -> Column:
        filled = F.transform(
            F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
            lambda i: F.struct(F.lit(kind).alias("kind"), (first + i).cast("int").alias("src_pos")),
        )
        return F.slice(filled, F.lit(1), F.greatest(count, F.lit(0)).cast("int"))

    head = F.least(n, F.lit(cut))
    parts = [span("text", F.lit(0), head)]
    for kind, count, present in slots:
        size = F.lit(count) if present is None else F.when(present, count).otherwise(0)
        parts.append(span(kind, F.lit(0), size))
    parts.append(span("text", head, n - head))
    return df.select(key, F.posexplode(F.concat(*parts)).alias("pos", "_slot")).select(
        key, "pos", "_slot.kind", "_slot.src_pos"
    )


def aligned_mask(
    ids: Column | str, cut: int, n_slots: int, pad_id: int = I.PAD
) -> Column:
    """Mask in the layout of ``slot_layout``: the slots' ones stand at the cut."""
    body = I.attention_mask(ids, pad_id, 0)
    return F.concat(
        F.slice(body, 1, cut),
        F.array_repeat(F.lit(1), n_slots),
        F.slice(body, F.lit(cut + 1), F.greatest(F.size(body), F.lit(0))),
    )


def wrap_segment(kind: Column | str, ids: Column | str) -> Column:
    """A media segment between its markers; text stays as it is."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    ids = F.col(ids) if isinstance(ids, str) else ids
    out = ids
    for m in I.MEDIA:
        opened, closed = I.markers([m])
        out = F.when(
            kind == m,
            F.concat(F.array(F.lit(opened)), ids, F.array(F.lit(closed))),
        ).otherwise(out)
    return out


def interleave(
    segments: DataFrame,
    key: str,
    order: str,
    kind: str,
    ids: str,
    max_len: int = 8192,
) -> DataFrame:
    """``key, part_no, input_ids``: the segments of a document as one sequence.

    ``<s>``, the segments in order with media between their markers, ``<eos>``. A
    sequence longer than ``max_len`` continues in the next part, so a document of
    any length is never gathered in one row.
    """
    edges = (
        segments.groupBy(key)
        .agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
        .select(
            key,
            F.inline(
                F.array(
                    F.struct(F.col("_first").alias(order), F.lit(0).alias("_side"), F.array(F.lit(I.BOS)).alias("_ids")),
                    F.struct(F.col("_last").alias(order), F.lit(2).alias("_side"), F.array(F.lit(I.EOS)).alias("_ids")),
                )
            ),
        )
    )
    body = segments.select(key, order, F.lit(1).alias("_side"), wrap_segment(kind, ids).alias("_ids"))
    packed = pack_by_key(
        body.unionByName(edges), [key], ["_ids"], max_len, [order, "_side"]
    )
    return packed.select(key, F.col("block_no").alias("part_no"), F.col("_ids").alias("input_ids"))
