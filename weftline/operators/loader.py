"""Loader batches, rank shards, step plans and resuming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import checkpoint_step
from .ordering import with_ordinal

WARMUP_SHARE = 0.01


def with_batch(df: DataFrame, order: Sequence[str], batch_size: int = 1) -> DataFrame:
    """Add ``batch_id`` and ``row_no`` (its place in the batch)."""
    size = int(batch_size)
    return with_ordinal(df, order, "_ord").withColumns(
        {
            "batch_id": F.expr(f"_ord div {size}"),
            "row_no": F.expr(f"cast(_ord % {size} as int)"),
        }
    ).drop("_ord")


def to_batches(
    df: DataFrame, order: Sequence[str], cols: Sequence[str], batch_size: int = 1, same_size: bool = True
) -> DataFrame:
    """``batch_id, n_rows`` and each column as an array over the rows of the batch.

    With ``same_size`` the arrays of one batch must have one length, or it is an
    error. The last batch may be short. A batch holds at most ``batch_size`` rows.
    """
    return collate(with_ordinal(df, order, "_ord"), F.col("_ord"), cols, batch_size, same_size)


def collate(
    df: DataFrame, ordinal: Column, cols: Sequence[str], batch_size: int = 1, same_size: bool = True
) -> DataFrame:
    """``to_batches`` for rows that have a dense ordinal from 0."""
    rows = F.sort_array(F.collect_list(F.struct("row_no", *cols)))
    place = ordinal.cast("bigint")
    size = F.lit(int(batch_size))
    batches = (
        df.withColumns(
            {"batch_id": F.floor(place / size).cast("bigint"), "row_no": F.pmod(place, size).cast("int")}
        )
        .groupBy("batch_id")
        .agg(rows.alias("_rows"))
        .select(
            "batch_id",
            F.size("_rows").alias("n_rows"),
            *[F.col(f"_rows.{c}").alias(c) for c in cols],
        )
    )
    if not same_size:
        return batches

    def rectangular(c: str) -> Column:
        sizes = F.transform(F.col(c), lambda v: F.size(v))
        return (
            F.when(F.array_min(sizes) == F.array_max(sizes), F.col(c))
            .otherwise(F.raise_error(F.lit(f"rows of {c} in one batch differ in length")))
            .alias(c)
        )

    return batches.select("batch_id", "n_rows", *[rectangular(c) for c in cols])


def shard_batches(
    df: DataFrame, world_size: int, even: bool = False, n_batches: int | None = None
) -> DataFrame:
    """Add ``rank`` and ``local_step`` to rows with a dense ``batch_id``.

    With ``even`` the first batches are repeated at the end until every rank has
    the same number of steps. ``n_batches`` saves a pass over ``df`` to count them.
    """
    w = int(world_size)
    if even:
        n = n_batches
        if n is None:
            last = df.agg(F.max("batch_id")).first()[0]
            n = 0 if last is None else last + 1
        total = -(-n // w) * w
        if total > n:
            rounds = F.sequence(F.lit(0).cast("bigint"), F.expr(f"({total - 1} - batch_id) div {n}"))
            df = df.withColumn("_round", F.explode(rounds)).withColumn(
                "batch_id", F.col("batch_id") + F.col("_round") * n
            ).drop("_round")
    return df.withColumns(
        {
            "rank": F.expr(f"cast(batch_id % {w} as int)"),
            "local_step": F.expr(f"batch_id div {w}"),
        }
    )


def write_ranks(df: DataFrame, path: str, steps_per_file: int = 1024) -> None:
    """Write rank shards as directories ``rank=0`` ... of one parquet table.

    A file holds ``steps_per_file`` consecutive steps of one rank, in order, so the
    number of files does not grow with the number of tasks.
    """
    chunk = F.expr(f"local_step div {int(steps_per_file)}")
    (
        df.repartition("rank", chunk)
        .sortWithinPartitions("rank", "local_step")
        .write.partitionBy("rank")
        .parquet(path)
    )


def step_plan(batches: DataFrame, batch: int = 1, world: int = 1, accum: int = 1) -> DataFrame:
    """One row: batches, optimizer steps and warm-up, before and after sharding."""

    def steps(n: Column) -> Column:
        return F.ceil(n / F.lit(float(accum))).cast("bigint")

    n = F.count(F.lit(1))
    return (
        batches.agg(n.alias("n_batches"))
        .withColumn("max_steps", steps(F.col("n_batches")))
        .withColumn("batches_per_rank", F.ceil(F.col("n_batches") / F.lit(float(world))).cast("bigint"))
        .withColumn("max_steps_per_rank", steps(F.col("batches_per_rank")))
        .withColumn(
            "warmup_steps", F.floor(F.col("max_steps").cast("double") * F.lit(WARMUP_SHARE)).cast("bigint")
        )
        .withColumn("total_batch", F.lit(batch * world * accum).cast("bigint"))
    )


def skip_first_batches(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("batch_id") >= n)


def on_cadence(step: str, every: int, stop: int | None = None, include_zero: bool = True) -> Column:
    """True where the step is a multiple of ``every`` and below ``stop``.

    Log lines start at step 0; checkpoints do not (``include_zero=False``).
    """
    keep = F.col(step) % every == 0
    if stop is not None:
        keep = keep & (F.col(step) < stop)
    return keep if include_zero else keep & (F.col(step) > 0)


def at_cadence(
    df: DataFrame, every: int, stop: int | None = None, step: str = "step", include_zero: bool = True
) -> DataFrame:
    """Rows whose step is ``on_cadence``."""
    return df.where(on_cadence(step, every, stop, include_zero))


def accumulate(df: DataFrame, every: int, step: str = "step", value: str = "loss", by: Sequence[str] = ()) -> DataFrame:
    """Mean value of each optimizer step; one step takes ``every`` batches."""
    return df.groupBy(*by, F.expr(f"{step} div {int(every)}").alias("opt_step")).agg(
        F.count(F.lit(1)).alias("n_batches"), F.avg(value).alias(f"mean_{value}")
    )


def resume_step(df: DataFrame, name: str = "name", accum: int = 1) -> DataFrame:
    """Add where each named checkpoint resumes; NULL for other names."""
    return df.withColumn("completed_steps", checkpoint_step(name)).withColumn(
        "batches_to_skip", F.col("completed_steps") * F.lit(accum).cast("bigint")
    )


def latest_checkpoint(df: DataFrame, name: str = "name", accum: int = 1) -> DataFrame:
    """One row: the newest checkpoint of a listing and where it resumes."""
    return (
        resume_step(df, name, accum)
        .where(F.col("completed_steps").isNotNull())
        .agg(
            F.max_by(name, F.struct("completed_steps", name)).alias(name),
            F.max("completed_steps").alias("completed_steps"),
            F.max("batches_to_skip").alias("batches_to_skip"),
        )
    )
