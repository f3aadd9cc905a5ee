"""Projection by a matrix that no executor should hold whole."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import cut_lineage
from .ordering import with_ordinal
from .vocabulary import int32_offsets

BLOCK = 1024
CHUNK_BYTES = 4 << 20
CHUNKS_PER_TASK = 64

_PARTIAL = "_chunk long, _row_block int, _col_block int, _values binary"


def project_blocked(
    df: DataFrame,
    vec: str,
    weights: DataFrame,
    key: Sequence[str],
    out: str = "projected",
    block_rows: int = BLOCK,
    block_cols: int = BLOCK,
    chunk_bytes: int = CHUNK_BYTES,
    chunks_per_task: int = CHUNKS_PER_TASK,
) -> DataFrame:
    """``key, <out>``: ``W x`` as in ``project``, with ``W`` cut into blocks.

    A task holds one block of ``block_rows`` x ``block_cols`` values and the vectors pass it in
    chunks (``chunk_bytes`` of vectors or of results, one vector at least); the partial
    sums of a chunk are added in one task, in the order of the blocks. Every chunk is shuffled
    once per row of blocks, every block once per ``chunks_per_task`` chunks: a matrix of few
    blocks does not bring all vectors to few tasks. One row per row of ``df``; a NULL vector stays NULL;
    a vector of another length than the matrix is wide is an error, and so are rows of
    the matrix that differ in length.
    """
    spark = df.sparkSession
    rows, cols = int(block_rows), int(block_cols)
    weights = cut_lineage(weights.select("out_dim", "w"), "weights")
    size = weights.agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.size("w"), F.lit(0))).alias("least"), F.max(F.size("w")).alias("width")).first()
    height, width = size["n"], size["width"]
    if not height:
        empty = F.when(F.col(vec).isNotNull(), F.array().cast("array<double>"))
        return df.select(*key, empty.alias(out))
    if size["least"] != width or not width:
        raise ValueError(f"rows of the matrix have between {size['least']} and {width} values")
    per_chunk = max(1, int(chunk_bytes) // (8 * max(width, height)))
    # Chunks get their numbers from rows that are written, so that a task that runs again sends the same ones.
    chunks = cut_lineage(_chunks(df, vec, key, width, per_chunk).withColumn("_chunk", F.monotonically_increasing_id()), "chunks")
    n_chunks = chunks.count()
    copies = max(1, -(-n_chunks // int(chunks_per_task)))
    n_rows, n_cols = -(-height // rows), -(-width // cols)

    place = ["_row_block", "_col_block", "_copy"]
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy")
    blocks = _blocks(weights, rows, cols).select("_row_block", "_col_block", copy, F.lit(-1).cast("bigint").alias("_chunk"), "_values")
    vectors = _slices(chunks.select("_chunk", "_values"), width, cols).select(
        F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("_row_block"),
        "_col_block",
        F.pmod(F.xxhash64("_chunk"), F.lit(copies)).cast("int").alias("_copy"),
        "_chunk",
        "_values",
    )
    met = blocks.unionByName(vectors).repartition(n_rows * n_cols * copies, *place).sortWithinPartitions(*place, "_chunk")
    partial = met.mapInArrow(_multiply(width, cols), _PARTIAL)

    heads = chunks.select("_chunk", F.lit(-1).alias("_row_block"), F.lit(0).alias("_col_block"), F.lit(None).cast("binary").alias("_values"), "_keys", "_present")
    sums = heads.unionByName(partial, allowMissingColumns=True).repartition(max(1, copies, n_chunks // 16), "_chunk")
    given = df.select(*key).schema.fields
    schema = StructType([*[StructField(f.name, f.dataType) for f in given], StructField(out, ArrayType(DoubleType()))])
    return sums.sortWithinPartitions("_chunk", "_row_block", "_col_block").mapInArrow(
        _add([*key, out], height, rows), schema
    )


def _chunks(df: DataFrame, vec: str, key: Sequence[str], width: int, per_chunk: int) -> DataFrame:
    """``_keys, _present, _values``: up to ``per_chunk`` rows, the vectors as one run of doubles."""
    given = df.select(F.struct(*key).alias("_keys"), F.col(vec).cast("array<double>").alias("_vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, per_chunk):
                part = batch.slice(start, per_chunk)
                vectors = part.column("_vec")
                present = np.asarray(vectors.is_valid())
                held = vectors.drop_null()
                if len(held) and not np.all(np.asarray(held.value_lengths()) == width):
                    raise ValueError(f"a vector does not have the {width} values of the matrix's rows")
                values = np.asarray(held.flatten(), dtype=np.float64)
                offsets = pa.array([0, part.num_rows], pa.int32())
                yield pa.record_batch(
                    {
                        "_keys": pa.ListArray.from_arrays(offsets, part.column("_keys")),
                        "_present": pa.ListArray.from_arrays(offsets, pa.array(present)),
                        "_values": pa.array([values.tobytes()], pa.binary()),
                    }
                )

    kind = given.select(F.array("_keys").alias("_keys"), F.array(F.lit(True)).alias("_present"), F.lit(b"").alias("_values")).schema
    return given.mapInArrow(run, kind)


def _slices(chunks: DataFrame, width: int, cols: int) -> DataFrame:
    """``_chunk, _col_block, _values``: each chunk cut at the columns of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, values in zip(batch.column("_chunk"), batch.column("_values")):
                vectors = np.frombuffer(values.as_py(), dtype=np.float64).reshape(-1, width)
                for start in range(0, width, cols):
                    yield pa.record_batch(
                        {
                            "_chunk": pa.array([chunk.as_py()], pa.int64()),
                            "_col_block": pa.array([start // cols], pa.int32()),
                            "_values": pa.array([vectors[:, start : start + cols].tobytes()], pa.binary()),
                        }
                    )

    return chunks.mapInArrow(run, "_chunk long, _col_block int, _values binary")


def _blocks(weights: DataFrame, rows: int, cols: int) -> DataFrame:
    """``_row_block, _col_block, _values``: the matrix in blocks, row by row."""
    ordered = with_ordinal(weights, ["out_dim"], "_row", staged=True)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(cols))
    cut = F.transform(starts, lambda i: F.struct((i / cols).cast("int").alias("_col_block"), F.slice("w", i + 1, cols).cast("array<double>").alias("_w")))
    pieces = ordered.select(F.expr(f"cast(_row div {rows} as int)").alias("_row_block"), "_row", F.inline(cut))
    listed = pieces.groupBy("_row_block", "_col_block").agg(F.sort_array(F.collect_list(F.struct("_row", "_w"))).alias("_rows"))
    return listed.select("_row_block", "_col_block", _packed(F.flatten(F.col("_rows._w"))).alias("_values"))


def _packed(lists: Column) -> Column:
    """Arrays of doubles as their bytes."""

    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        return pa.array([np.asarray(v.values, dtype=np.float64).tobytes() for v in column], pa.binary())

    return pack(lists)


def _multiply(width: int, cols: int):
    """A block comes before the chunks that it is multiplied with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            place = zip(*(batch.column(c).to_pylist() for c in ("_row_block", "_col_block", "_copy", "_chunk")))
            for (row, col, copy, chunk), values in zip(place, batch.column("_values")):
                given = np.frombuffer(values.as_py(), dtype=np.float64).reshape(-1, min(cols, width - col * cols))
                if chunk < 0:
                    at, block = (row, col, copy), given
                    continue
                if at != (row, col, copy):
                    raise RuntimeError(f"block {row}, {col} of the matrix is missing")
                yield pa.record_batch(
                    {
                        "_chunk": pa.array([chunk], pa.int64()),
                        "_row_block": pa.array([row], pa.int32()),
                        "_col_block": pa.array([col], pa.int32()),
                        "_values": pa.array([(given @ block.T).tobytes()], pa.binary()),
                    }
                )

    return run


def _add(names: list[str], height: int, rows: int):
    """The keys of a chunk come before its partial sums."""

    def finished(keys: pa.Array, present: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        offsets = int32_offsets(np.concatenate([[0], np.cumsum(present * height, dtype=np.int64)]))
        projected = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()), mask=pa.array(~present))
        return pa.RecordBatch.from_arrays([*keys.flatten(), projected], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.column("_row_block")[i].as_py()
                if row < 0:
                    if head:
                        yield finished(*head)
                    present = np.asarray(batch.column("_present")[i].values)
                    head = batch.column("_keys")[i].values, present, np.zeros((present.sum(), height))
                    continue
                values = np.frombuffer(batch.column("_values")[i].as_py(), dtype=np.float64)
                part = head[2][:, row * rows : (row + 1) * rows]
                part += values.reshape(part.shape)
        if head:
            yield finished(*head)

    return run
