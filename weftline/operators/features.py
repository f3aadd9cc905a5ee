"""Media feature tables: frames, pooling, projection, encoders, weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..session import cut_lineage
from .ordering import with_offsets, with_ordinal
from .vocabulary import BROADCAST_BYTES, int32_offsets


def stack_frames(
    frames: DataFrame,
    key: Sequence[str],
    order: str,
    value: str,
    chunk_frames: int = 4096,
) -> DataFrame:
    """``key, chunk_no, n_frames, <value>``: the frames of a key in order.

    A key with up to ``chunk_frames`` frames gives one row; a longer one goes on in
    the next chunk, so no task gathers a key of unbounded length. Frames of one chunk
    must have one size, or it is an error.
    """
    keys = [f"_key_{k}" for k in key]
    placed = with_offsets(
        frames, [*key, order], groups={n: F.col(k) for n, k in zip(keys, key)}
    ).withColumn("chunk_no", F.expr(f"rel div {int(chunk_frames)}"))
    rows = F.sort_array(F.collect_list(F.struct(order, value)))
    sizes = F.size(value)
    stacked = (
        placed.groupBy(*key, "chunk_no")
        .agg(rows.alias("_rows"), F.min(sizes).alias("_least"), F.max(sizes).alias("_most"))
    )
    return stacked.select(
        *key,
        "chunk_no",
        F.size("_rows").alias("n_frames"),
        F.when(F.col("_least") == F.col("_most"), F.col(f"_rows.{value}"))
        .otherwise(F.raise_error(F.lit("frames of one video differ in size")))
        .alias(value),
    )


def channel_first(
    frames: DataFrame, key: str, order: str, channel: str, value: str, chunk_frames: int = 4096
) -> DataFrame:
    """``[time, channel]`` rows to one row per channel with its frames over time."""
    return stack_frames(frames, [key, channel], order, value, chunk_frames)


def flatten_features(df: DataFrame, column: str, levels: int = 1) -> DataFrame:
    """Nested feature arrays to one vector per row."""
    out = F.col(column)
    for _ in range(levels):
        out = F.flatten(out)
    return df.withColumn(column, out)


def mean_pool(frames: DataFrame, key: Sequence[str], vec: str) -> DataFrame:
    """Mean over the frames of a key, per dimension.

    The running sums of a key are one vector per task, so frames are neither
    exploded nor gathered.
    """
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("_vec"))))
    return (
        frames.select(*key, F.col(vec).cast("array<double>").alias("_vec"))
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_frames"), mean.alias(vec))
    )


def project(
    df: DataFrame,
    vec: str,
    weights: DataFrame,
    key: Sequence[str],
    out: str = "projected",
    slice_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``key, <out>``: ``W x`` without bias; ``weights`` has rows ``out_dim, w``.

    The matrix goes to the tasks in slices of at most ``slice_bytes`` (one row at
    least), and whole Arrow batches are multiplied, so no vector is taken apart or
    shuffled. One row per row of ``df``; a NULL vector stays NULL.
    """
    rows = cut_lineage(weights.select("out_dim", "w"), "weights")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("w")).alias("width")).first()
    if not size["n"]:
        empty = F.when(F.col(vec).isNotNull(), F.array().cast("array<double>"))
        return df.select(*key, empty.alias(out))
    step = max(1, slice_bytes // (8 * max(size["width"], 1)))
    ordered = with_ordinal(rows, ["out_dim"], "_row", staged=True)
    parts = []
    for first in range(0, size["n"], step):
        part = ordered.where((F.col("_row") >= first) & (F.col("_row") < first + step)).orderBy("_row")
        listed = part.select("w").toArrow()["w"].combine_chunks()
        matrix = np.asarray(listed.flatten(), dtype=np.float64).reshape(len(listed), -1)
        parts.append(_product(df.sparkSession.sparkContext.broadcast(matrix), F.col(vec)))
    return df.select(*key, (F.concat(*parts) if len(parts) > 1 else parts[0]).alias(out))


def _product(shared, vec: Column) -> Column:
    """One slice of the matrix times the vector."""

    @F.arrow_udf("array<double>")
    def multiply(column: pa.Array) -> pa.Array:
        w = shared.value
        given = np.asarray(column.drop_null().flatten(), dtype=np.float64).reshape(-1, w.shape[1])
        values = pa.array((given @ w.T).ravel())
        present = np.asarray(column.is_valid())
        offsets = int32_offsets(np.concatenate([[0], np.cumsum(present * len(w), dtype=np.int64)]))
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~present))

    return multiply(vec)


def encode_features(
    df: DataFrame,
    column: str,
    make_predict_fn: Callable,
    size: int,
    batch_size: int = 256,
    out: str = "encoded",
) -> DataFrame:
    """Run a user-given encoder over a vector column.

    ``make_predict_fn`` loads the model; it runs once per Python worker, and the
    function it returns gets a NumPy batch.
    """
    predict = predict_batch_udf(
        make_predict_fn,
        return_type=ArrayType(FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[size]],
    )
    return df.withColumn(out, predict(F.col(column)))


def normal_value(seed: int, *at: Column) -> Column:
    """A standard normal number that depends on the seed and the place only.

    The bits are those of an MD5 digest, which other systems compute alike.
    """

    def uniform(part: int) -> Column:
        # 52 bits, shifted by one half, so never 0 or 1.
        place = F.concat_ws("|", F.lit(str(seed)), F.lit(str(part)), *[a.cast("string") for a in at])
        bits = F.conv(F.substring(F.md5(place.cast("binary")), 1, 13), 16, 10).cast("bigint")
        return (bits.cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(F.lit(2.0 * np.pi) * uniform(2))


def init_weights(
    rows: DataFrame, row: str, dim: int, seed: int = 42, std: float | None = None, pad_row: int | None = None
) -> DataFrame:
    """``<row>, w``: one normal vector per row, ``std = dim ** -0.5`` by default.

    A value depends on seed, row and column, not on the partitioning. ``pad_row``
    is the row that stays zero.
    """
    std = dim ** -0.5 if std is None else std
    values = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: normal_value(seed, F.col(row), j) * F.lit(std)
    )
    if pad_row is not None:
        zeros = F.array_repeat(F.lit(0.0), dim)
        values = F.when(F.col(row) == pad_row, zeros).otherwise(values)
    return rows.select(row, values.alias("w"))


def weight_values(rows: DataFrame, row: str, dim: int, seed: int = 42, std: float | None = None) -> DataFrame:
    """``<row>, dim, x``: the numbers of ``init_weights`` as rows, for work on single values.

    Exploding the vectors instead would make all of them again for a filter on their size, which
    Catalyst moves below a grouping of ``rows``: once for each row that goes into a group.
    """
    std = dim ** -0.5 if std is None else std
    placed = rows.select(row, F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("dim"))
    return placed.withColumn("x", normal_value(seed, F.col(row), F.col("dim")) * F.lit(std))
