"""Routing by modality: catalogue choice, handlers, lists of mixed parts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .quality import require

CATALOGUE_SCHEMA = "modelId string, tags array<string>, likes bigint"


def parse_catalogue(df: DataFrame, json_col: str, ord_col: str) -> DataFrame:
    """``ord, model_id, tags, likes`` from one JSON object per row."""
    entry = F.from_json(json_col, CATALOGUE_SCHEMA)
    return df.select(F.col(ord_col).alias("ord"), entry.alias("_e")).select(
        "ord", F.col("_e.modelId").alias("model_id"), "_e.tags", "_e.likes"
    )


def choose_model(
    catalogue: DataFrame,
    modalities: DataFrame,
    rank_by: str | None = "likes",
    on_missing: str = "error",
) -> DataFrame:
    """For each modality the entry that has it as a tag and the most likes.

    Ties go to the entry that comes first (``ord``); ``rank_by=None`` takes the first
    match. A modality without entry is an error, or NULL with ``on_missing='null'``.
    The best entry of a tag is an aggregate, so a common tag needs no sort.
    """
    first = (-F.col("ord")).alias("before")
    rank = F.struct(F.col(rank_by).alias("by"), first) if rank_by else F.struct(first)
    best = (
        catalogue.select("ord", "model_id", "likes", F.explode(F.array_distinct("tags")).alias("modality"))
        .groupBy("modality")
        .agg(F.max_by(F.struct("model_id", "likes", "ord"), rank).alias("_best"))
    )
    out = modalities.join(best, "modality", "left").select("modality", "_best.*")
    if on_missing == "error":
        message = F.concat(F.lit("no entry for modality "), F.col("modality"))
        return require(out, F.col("model_id").isNotNull(), message)
    return out


def handled(modality: Column, handlers: Mapping[str, Callable[[Column], Column]], data: Column) -> Column:
    """The handler of the modality applied to the data; NULL without a handler."""
    out = None
    for name, handler in handlers.items():
        out = (
            F.when(modality == name, handler(data))
            if out is None
            else out.when(modality == name, handler(data))
        )
    return out


def route(
    df: DataFrame,
    handlers: Mapping[str, Callable[[Column], Column]],
    modality: str = "modality",
    data: str = "data",
    out: str = "tokens",
) -> DataFrame:
    """Add ``out``: each row processed by its modality's column function."""
    return df.withColumn(out, handled(F.col(modality), handlers, F.col(data)))


def route_tables(
    df: DataFrame, handlers: Mapping[str, Callable[[DataFrame], DataFrame]], modality: str = "modality"
) -> DataFrame:
    """Like ``route`` for handlers that work on whole tables; results are united.

    Rows that no handler takes stay: columns that the handlers make are NULL there.
    """
    out: DataFrame | None = None
    for name, handler in handlers.items():
        part = handler(df.where(F.col(modality) == name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no handlers")
    other = df.where(~F.coalesce(F.col(modality).isin(list(handlers)), F.lit(False)))
    nulls = [
        F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema
    ]
    return out.unionByName(other.select(*nulls))


def process_any(
    df: DataFrame, parts: str, handlers: Mapping[str, Callable[[Column], Column]], out: str = "outputs"
) -> DataFrame:
    """Process every ``{modality, data}`` element of a list, in input order."""
    return df.withColumn(
        out, F.transform(F.col(parts), lambda p: handled(p["modality"], handlers, p["data"]))
    )


def requested(df: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """The given modalities as a table, for ``choose_model``."""
    return df.sparkSession.createDataFrame([(m,) for m in modalities], "modality string")
