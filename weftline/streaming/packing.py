"""Pack arriving documents; what is left of a micro-batch waits for the next one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType

from .run import progress_path


def pack_stream(
    sdf: DataFrame,
    key: str,
    block_size: int,
    ids: str = "input_ids",
    order: str = "doc_id",
    lanes: int = 16,
    lane: Column | None = None,
) -> DataFrame:
    """``key, lane, block_no, <ids>``: full blocks per key and lane.

    ``ids`` is an array of ids or a string with one character per id (see
    ``byte_chars``). A key is split into ``lanes`` by a hash of its documents, or by
    ``lane``, so a key with a large share of the stream is packed by several tasks. The
    state of a lane is fewer than ``block_size`` ids (see ``stream_tails``). Micro-batches are
    taken as they arrive; inside one, the documents of a lane are sorted by ``order``, so a lane
    of a micro-batch has to fit into memory.
    """
    size = int(block_size)
    key_type = sdf.schema[key].dataType.simpleString()
    is_text = isinstance(sdf.schema[ids].dataType, StringType)
    kind = "string" if is_text else "array<int>"

    def pack(
        group: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        rest, number = state.get if state.exists else ("" if is_text else [], 0)
        arrived = list(frames)
        if arrived:
            documents = pd.concat(arrived).sort_values(order, kind="stable")[ids]
            if is_text:
                rest = "".join([rest, *documents])
            else:
                rest = np.concatenate([np.asarray(rest, dtype=np.int32), *documents]).astype(np.int32)
            full = len(rest) // size
            blocks = [rest[i * size : (i + 1) * size] for i in range(full)]
            rest = rest[full * size :]
            if blocks:
                numbers = range(number, number + full)
                number += full
                yield pd.DataFrame(
                    {key: group[0], "lane": group[1], "block_no": numbers, ids: blocks}
                )
        state.update((rest if is_text else [int(v) for v in rest], int(number)))

    if lane is None:
        lane = F.pmod(F.xxhash64(order), F.lit(int(lanes)))
    return (
        sdf.select(key, order, ids, lane.cast("int").alias("lane"))
        .groupBy(key, "lane")
        .applyInPandasWithState(
            pack,
            f"{key} {key_type}, lane int, block_no bigint, {ids} {kind}",
            f"carry {kind}, next_block bigint",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def stream_tails(spark: SparkSession, path: str, key: str, ids: str = "input_ids") -> DataFrame:
    """``key, lane, block_no, <ids>``: what is left of each lane, as one short block.

    ``path`` is the table that ``run_to_parquet`` wrote; the rest is read from the state that the
    query keeps beside it. It stays there, so a query that goes on still begins with it.
    """
    state = spark.read.format("statestore").load(progress_path(path))
    rest = state.select(
        F.col(f"key.{key}").alias(key),
        F.col("key.lane").alias("lane"),
        F.col("value.groupState.next_block").alias("block_no"),
        F.col("value.groupState.carry").alias(ids),
    )
    is_text = isinstance(rest.schema[ids].dataType, StringType)
    return rest.where((F.length(ids) if is_text else F.size(ids)) > 0)
