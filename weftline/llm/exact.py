"""Exact duplicates: a new batch is screened by the static filters of an immutable snapshot.

Texts are equal when they are identical after all of ``[\\x20\\x09-\\x0D]`` is deleted; NULL
counts as empty. The snapshot's digests lie in buckets, each with a binary-fuse filter.
Digests of the new batch that pass their bucket's filter are joined with the exact bucket,
which settles the few false ones; duplicates inside the batch, and inside the snapshot, are
found by grouping. Every group of equal digests is then checked on the bytes of its texts,
so even texts whose digests clash are told apart.

A hot text (a third of all rows) is one row per task after the partial sums of each
grouping. Only digests, and the texts of repeated digests, take part in what is grouped.
Repeated rows are duplicates of each other, also under one ``doc_id``; ties go to the
smallest ``doc_id``, NULL last. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from . import fuse

KEYS_PER_BUCKET = 50_000


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def filters(keys: DataFrame) -> DataFrame:
    """One filter per bucket of ``keys`` (``_bucket``, distinct ``digest``)."""

    def make(group: pd.DataFrame) -> pd.DataFrame:
        f = fuse.build(_words(group["digest"]))
        return pd.DataFrame(
            {"_bucket": group["_bucket"].iloc[:1], "seed": f.seed, "segment": f.segment, "segments": f.segments, "slots": [f.slots.tobytes()]}
        )

    return keys.groupBy("_bucket").applyInPandas(make, "_bucket long, seed int, segment int, segments int, slots binary")


def _words(digests: pd.Series) -> np.ndarray:
    """The first eight bytes of each digest; digests that agree in them share a key."""
    return np.unique(_prefix(digests))


def _prefix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[:8].ljust(8, b"\0") for d in digests), "<u8")


def screen(batch: DataFrame, made: DataFrame) -> DataFrame:
    """Digests of ``batch`` (``_bucket``, distinct ``digest``) that pass the filter of their bucket."""

    def passing(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:
            return rows.iloc[:0][["digest"]]
        r = own.iloc[0]
        f = fuse.Filter(int(r["seed"]), int(r["segment"]), int(r["segments"]), np.frombuffer(r["slots"], np.uint16))
        return rows.loc[fuse.contains(f, _prefix(rows["digest"])), ["digest"]]

    return batch.groupBy("_bucket").cogroup(made.groupBy("_bucket")).applyInPandas(passing, "digest binary")


def exact_dedup(docs: DataFrame, in_snapshot: Column, digest=sha256) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``in_snapshot`` says which rows form the immutable snapshot, the others are the new
    batch. The row with the most code points, then the smallest ``doc_id``, stays; of rows that
    repeat it entirely one stays. ``digest`` may be replaced (tests use one that clashes).
    """
    rows = cut_lineage(
        docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), in_snapshot.alias("_old"), normal(F.col("text")).alias("_normal")).select(
            "doc_id", "n_chars", F.coalesce("_old", F.lit(False)).alias("_old"), digest(F.col("_normal")).alias("digest"), F.sha2("_normal", 256).alias("text_sha256")
        ),
        "digests",
    )
    counts = rows.groupBy("digest").agg(
        F.sum(F.col("_old").cast("bigint")).alias("old"), F.sum((~F.col("_old")).cast("bigint")).alias("new")
    )
    buckets = max(1, math.ceil(rows.count() / KEYS_PER_BUCKET))
    counts = cut_lineage(counts.withColumn("_bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets))), "counts")
    store = counts.where("old > 0").select("_bucket", "digest")
    batch = counts.where("new > 0").select("_bucket", "digest")
    positive = screen(batch, filters(store)).join(store.select("digest"), "digest")
    repeated = positive.union(counts.where("old > 1 or new > 1").select("digest")).distinct()

    groups = cut_lineage(_groups(docs, cut_lineage(rows.join(repeated, "digest").select("doc_id", "digest").distinct(), "members"), digest), "groups")
    plain = groups.where("n_texts = 1").select("digest", "keep_id", "group_size")
    out = rows.join(plain, "digest", "left")
    clashing = groups.where("n_texts > 1")
    if not clashing.isEmpty():
        mixed = clashing.select("digest", "text_sha256", F.col("keep_id").alias("_k"), F.col("group_size").alias("_g"))
        out = out.join(mixed, ["digest", "text_sha256"], "left").select(
            "doc_id",
            "n_chars",
            "text_sha256",
            F.when(F.col("_g").isNull(), F.col("keep_id")).otherwise(F.col("_k")).alias("keep_id"),
            F.coalesce("_g", "group_size").alias("group_size"),
        )
    lone = F.col("group_size").isNull()
    # Rows that repeat each other under one doc_id: the longest comes first.
    among = Window.partitionBy("text_sha256", "doc_id").orderBy(F.desc("n_chars"))
    keep = F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.row_number().over(among) == 1)).alias("kept"),
        "text_sha256",
    )


def keep(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, in_snapshot).where("kept").select(F.col("doc_id").alias("_kept_id"), "text_sha256")
    name = fresh(docs, "_sha256")
    rows = docs.withColumn(name, F.sha2(normal(F.col("text")), 256))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_kept_id"]) & (rows[name] == kept["text_sha256"]), "left_semi")
    place = fresh(docs, "_place")
    among = Window.partitionBy("doc_id", name).orderBy(F.desc(F.coalesce(F.length("text"), F.lit(0))))
    return rows.withColumn(place, F.row_number().over(among)).where(F.col(place) == 1).drop(name, place)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _groups(docs: DataFrame, members: DataFrame, digest) -> DataFrame:
    """Groups of identical normalised texts among the rows named by ``members``."""
    texts = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), normal(F.col("text")).alias("_normal"))
    texts = texts.withColumn("digest", digest(F.col("_normal")))
    same = texts["doc_id"].eqNullSafe(members["doc_id"]) & (texts["digest"] == members["digest"])
    # One plan at every size: texts move once, however few the members are.
    found = texts.join(members.hint("merge"), same, "left_semi")
    order = F.struct("n_chars", F.col("doc_id").isNotNull(), -F.col("doc_id"))
    equal = found.groupBy("digest", "_normal").agg(
        F.count(F.lit(1)).alias("group_size"), F.max_by("doc_id", order).alias("keep_id")
    )
    equal = equal.select("digest", F.sha2("_normal", 256).alias("text_sha256"), "group_size", "keep_id")
    n_texts = equal.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"))
    return equal.join(n_texts, "digest")
