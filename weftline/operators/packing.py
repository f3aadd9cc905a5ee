"""Concatenate documents and cut them into blocks of a fixed number of ids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import END_CHAR, EOS, FIRST_PAYLOAD_ID
from .ordering import with_offsets


def batch_number(batch_rows: int) -> Column:
    return F.expr(f"ord div {int(batch_rows)}")


#: Bytes of text that become ids at once, a block at least; the arrays of a pass take about fifteen times as much.
SLICE_BYTES = 2 << 20


def char_ids(chars: Column | str) -> Column:
    """``ids_of_chars`` for many long strings: whole slices of an Arrow batch instead of character by character.

    Filter by the length of the string, not of the ids: Catalyst would make the ids twice.
    """

    @F.arrow_udf("array<int>")
    def to_ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield from _ids_by_slice(column, SLICE_BYTES)

    return to_ids(F.col(chars) if isinstance(chars, str) else chars)


def _ids_by_slice(column: pa.Array, size: int) -> Iterator[pa.Array]:
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)])
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        part = column.slice(first, stop - first)
        codes = np.frombuffer("".join(part.drop_null().to_pylist()).encode("utf-32-le"), dtype="<i4")
        ids = np.where(codes == ord(END_CHAR), EOS, codes + FIRST_PAYLOAD_ID).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(part), 0), dtype=np.int64)])
        missing = pa.array(np.asarray(part.is_null()))
        yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=missing)
        first = stop


def _size(col: str, chars: bool) -> Column:
    return F.char_length(col) if chars else F.size(col)


def _checked(cols: Sequence[str], size) -> list[Column]:
    """The columns, or an error where a length differs from the announced one.

    Naming a column twice also keeps Catalyst from moving its expression into the
    lambdas below, where it would run once per piece.
    """
    return [
        F.when(size(F.col(c)) == F.col("_len"), F.col(c))
        .otherwise(F.raise_error(F.lit(f"column {c} does not have the announced length")))
        .alias(c)
        for c in cols
    ]


def _array_pieces(cols: Sequence[str], size: int, wanted) -> Column:
    """``block_no, _at`` and one slice of each array per wanted block."""

    def piece(b: Column) -> Column:
        begin = F.greatest(b * size - F.col("_rel"), F.lit(0))
        stop = F.least((b + 1) * size - F.col("_rel"), F.col("_len"))
        take = (stop - begin).cast("int")
        return F.struct(
            b.alias("block_no"),
            (F.col("_rel") + begin).alias("_at"),
            *[F.slice(F.col(c), (begin + 1).cast("int"), take).alias(c) for c in cols],
        )

    return F.transform(F.filter(F.sequence("_b0", "_b1"), wanted), piece)


def _char_pieces(col: str, size: int, wanted) -> Column:
    """``block_no, _at`` and one substring per wanted block.

    Positions in a string are found by counting from its start, so the string is cut
    in one pass instead of once per piece.
    """
    head = F.least(F.col("_len"), (F.col("_b0") + 1) * size - F.col("_rel")).cast("int")
    rest = F.regexp_extract_all(F.substring(F.col(col), head + 1, F.char_length(col)), F.lit(f"(?s).{{1,{size}}}"), 0)
    listed = F.concat(F.array(F.substring(F.col(col), F.lit(1), head)), rest)
    numbered = F.transform(
        listed,
        lambda text, i: F.struct(
            (F.col("_b0") + i).alias("block_no"),
            F.greatest((F.col("_b0") + i) * size, F.col("_rel")).alias("_at"),
            text.alias(col),
        ),
    )
    return F.filter(numbered, lambda p: wanted(p["block_no"]))


def cut_blocks(
    placed: DataFrame,
    cols: Sequence[str],
    block_size: int,
    groups: Sequence[str] = (),
    chars: bool = False,
) -> DataFrame:
    """Blocks of the rows laid out by ``with_offsets``.

    ``cols`` are arrays of equal length, or with ``chars`` one string column that has
    a character per id. Each document gives one piece per block it touches, so what
    moves is never longer than a block, and a long document spreads over many blocks.
    Blocks that lie inside one range are put together where the range already
    is; only the blocks that cross the end of a range are shuffled.
    """
    size = int(block_size)
    groups = list(groups)
    rel = "rel" if groups else "start"
    docs = placed.where(F.col("_len") > 0).withColumns(
        {
            "_rel": F.col(rel),
            "_b0": F.expr(f"{rel} div {size}"),
            "_b1": F.expr(f"({rel} + _len - 1) div {size}"),
            # First and last block that lie inside the range.
            "_w0": F.expr(f"(_lo - _base + {size - 1}) div {size}"),
            "_w1": F.expr(f"(_hi - _base) div {size} - 1"),
        }
    )
    checked = _checked(cols, F.char_length if chars else F.size)

    def pieces(rows: DataFrame, wanted) -> DataFrame:
        rows = rows.select(
            "_range", *groups, "_rel", "_len", "_b0", "_b1", "_w0", "_w1", *checked
        )
        cut = _char_pieces(cols[0], size, wanted) if chars else _array_pieces(cols, size, wanted)
        return rows.select("_range", *groups, F.inline(cut))

    def join_up(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("_at", *cols)))
        joined = [
            (F.array_join(f"_parts.{c}", "") if chars else F.flatten(F.col(f"_parts.{c}"))).alias(c)
            for c in cols
        ]
        return rows.groupBy(*keys).agg(parts.alias("_parts")).select(*groups, "block_no", *joined)

    def is_whole(b: Column) -> Column:
        return (b >= F.col("_w0")) & (b <= F.col("_w1"))

    # Without coalesce, Catalyst would push different NULL checks below the shuffle of
    # the two branches, and they could not share it.
    has_whole = (F.col("_b1") >= F.col("_w0")) & (F.col("_b0") <= F.col("_w1"))
    has_crossing = (F.col("_b0") < F.col("_w0")) | (F.col("_b1") > F.col("_w1"))
    whole = docs.where(F.coalesce(has_whole, F.lit(False)))
    crossing = docs.where(F.coalesce(has_crossing, F.lit(False)))
    return join_up(pieces(whole, is_whole), ["_range", *groups, "block_no"]).unionByName(
        join_up(pieces(crossing, lambda b: ~is_whole(b)), [*groups, "block_no"])
    )


def pack_batches(
    df: DataFrame,
    cols: Sequence[str],
    block_size: int,
    batch_rows: int = 1000,
    order: Sequence[str] = ("doc_id",),
    length: Column | None = None,
    build: dict[str, Column] | None = None,
    keep_short: bool = True,
    ranges: int | None = None,
    chars: bool = False,
) -> DataFrame:
    """Pack every ``batch_rows`` consecutive rows on their own.

    The remainder of a batch is dropped, except that a batch shorter than one
    block stays as one short block. ``build`` names columns that are made after the
    shuffle; their length must be given as ``length``. ``chars``: see ``cut_blocks``.
    """
    length = _size(cols[0], chars) if length is None else length
    placed = with_offsets(
        df, order, length, {"batch_id": batch_number(batch_rows)}, ranges=ranges
    )
    placed = placed.withColumns(build) if build else placed
    blocks = cut_blocks(placed, cols, block_size, ["batch_id"], chars)
    full = _size(cols[0], chars) == int(block_size)
    return blocks.where(full | (F.col("block_no") == 0) if keep_short else full)


def pack_global(
    df: DataFrame,
    cols: Sequence[str],
    block_size: int,
    order: Sequence[str] = ("doc_id",),
    length: Column | None = None,
    build: dict[str, Column] | None = None,
    keep_tail: bool = False,
    ranges: int | None = None,
    chars: bool = False,
) -> DataFrame:
    """Pack the whole table as one sequence: at most one remainder."""
    length = _size(cols[0], chars) if length is None else length
    placed = with_offsets(df, order, length, ranges=ranges)
    placed = placed.withColumns(build) if build else placed
    blocks = cut_blocks(placed, cols, block_size, chars=chars)
    return blocks if keep_tail else blocks.where(_size(cols[0], chars) == int(block_size))


def pack_by_key(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    block_size: int,
    order: Sequence[str],
    length: Column | None = None,
    build: dict[str, Column] | None = None,
    ranges: int | None = None,
    chars: bool = False,
) -> DataFrame:
    """Pack each key on its own and keep its tail as a short block.

    A key may hold any share of the rows: it is cut into ranges like the rest.
    """
    length = _size(cols[0], chars) if length is None else length
    placed = with_offsets(
        df, [*keys, *order], length, {f"_key_{k}": F.col(k) for k in keys}, ranges=ranges
    )
    placed = placed.withColumns(build) if build else placed
    blocks = cut_blocks(placed, cols, block_size, [f"_key_{k}" for k in keys], chars)
    return blocks.withColumnsRenamed({f"_key_{k}": k for k in keys})


def pack_report(
    df: DataFrame,
    length: Column,
    block_size: int,
    batch_rows: int = 1000,
    order: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Ids in, kept and dropped per batch, and over all (``batch_id`` NULL)."""
    size = int(block_size)
    placed = with_offsets(
        df.select(*order, length.alias("_n")), order, F.col("_n")
    ).withColumn("batch_id", batch_number(batch_rows))
    per_batch = placed.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_len").alias("n_in")
    )
    short = F.col("n_in") < size
    kept = F.when(short, F.col("n_in")).otherwise(F.expr(f"(n_in div {size}) * {size}"))
    per_batch = per_batch.select(
        "batch_id",
        "n_rows",
        "n_in",
        kept.alias("n_kept"),
        (F.col("n_in") - kept).alias("n_dropped"),
        F.when(short, 0).otherwise(F.expr(f"n_in div {size}")).alias("full_blocks"),
        F.when(short & (F.col("n_in") > 0), 1).otherwise(0).alias("short_blocks"),
    )
    sums = ["n_rows", "n_in", "n_kept", "n_dropped", "full_blocks", "short_blocks"]
    return per_batch.rollup("batch_id").agg(
        F.grouping("batch_id").cast("int").alias("is_total"),
        *[F.sum(c).cast("bigint").alias(c) for c in sums],
    )
