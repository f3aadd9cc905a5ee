"""Row ordinals and running offsets over a whole table, without one big window.

The keys (order columns and length of every row) are written and sorted over the cluster by
Spark's own range partitioning. Running sums over them are exact, so the key ranges that the
rows are then cut into are chosen by what they hold: no range has more than one and a quarter
of its share of the lengths and rows, plus one row. First keys, rows and lengths of all ranges are
one written row. A row finds its range by bisection over the first keys, which the running
query reads and which are not part of its plan: a task that runs again after an executor
was lost puts every row where it was before. A window inside the range does the rest.

The order columns must identify a row, or it is an error. With ``ties`` equal keys share a
range and take their places among each other in any order; for rows that are the same
in all that matters.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, Window, functions as F

from ..session import cut_lineage

MAX_RANGES = 65_536
ROWS_PER_RANGE = 100_000
#: The first keys of all ranges together have at most about so many bytes as JSON; there are fewer ranges if need be.
BOUND_BYTES = 64 << 20

HIDDEN = ("_len", "_range", "_lo", "_hi", "_base")


#: Cells a range, from which ranges are put together.
CELLS = 4


@dataclass
class Ranges:
    """``n`` ranges, described by one written row.

    It has the arrays ``keys`` (the first keys of all ranges but the first, ascending), ``first``
    (rows before each range), ``lo`` and ``hi`` (lengths before it and up to its end).
    """

    n: int
    row: DataFrame

    def __getitem__(self, name: str) -> Column:
        return self.row.scalar()[name]

    def of_row(self, name: str) -> Column:
        return F.get(self[name], F.col("_range"))


def _ranges(keys: DataFrame, seen: Row, order: Sequence[str], ranges: int | None, ties: bool) -> Ranges:
    """Cut written keys (``order``, ``_len``) into ranges of about equal weight: length and one a row."""
    spark, key = keys.sparkSession, F.struct(*order)
    weight = seen["rows"] + seen["sum"]
    if ranges is None:
        ranges = max(4 * spark.sparkContext.defaultParallelism, math.ceil(seen["rows"] / ROWS_PER_RANGE))
    ranges = max(1, min(ranges, MAX_RANGES, seen["rows"], BOUND_BYTES // (seen["key_bytes"] + 1)))
    spread = keys.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order)
    # Equal keys have the same sum, hence the same cell.
    upto = F.sum(F.col("_len") + 1).over(inside.rangeBetween(Window.unboundedPreceding, 0))
    if not ties:
        tie = F.coalesce(F.lag(key).over(inside) == key, F.lit(False))
        said = F.concat(F.lit(f"two rows with the same {', '.join(order)}: "), F.to_json(key))
        upto = F.when(tie, F.raise_error(said).cast("bigint")).otherwise(upto)

    def cell(sums: str, parts: int) -> Column:
        return F.expr(f"cast(cast({sums} - 1 as decimal(38, 0)) * {parts} div {max(weight, 1)} as bigint)")

    cells = (
        spread.withColumn("_upto", upto)
        .groupBy("_part", cell("_upto", CELLS * ranges).alias("_cell"))
        .agg(F.min(key).alias("_key"), F.count(F.lit(1)).alias("_rows"), F.sum("_len").alias("_sum"))
    )
    # At most (CELLS + 1) * MAX_RANGES rows, then at most MAX_RANGES.
    along = Window.orderBy("_part", "_cell").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        cells.withColumn("_all", F.sum(F.col("_sum") + F.col("_rows")).over(along))
        .groupBy(cell("_all", ranges).alias("_cell"))
        .agg(F.min("_key").alias("_key"), F.sum("_rows").alias("_rows"), F.sum("_sum").alias("_sum"))
    )
    running = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("_sum").over(running)
    first = F.sum("_rows").over(running) - F.col("_rows")
    n = Observation()
    listed = merged.select("_cell", "_key", first.alias("first"), (hi - F.col("_sum")).alias("lo"), hi.alias("hi"))
    listed = listed.observe(n, F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct("_cell", "_key", "first", "lo", "hi"))).alias("_r"))
    arrays = [F.slice("_r._key", F.lit(2), F.greatest(F.size("_r") - 1, F.lit(0))).alias("keys"), *[F.col(f"_r.{c}").alias(c) for c in ("first", "lo", "hi")]]
    row = cut_lineage(listed.select(F.struct(*arrays).alias("ranges")), "ranges")
    return Ranges(n.get["n"], row)


def _with_range(df: DataFrame, order: Sequence[str], found: Ranges) -> DataFrame:
    """Add ``_range``, the number of first keys at or below the row's key, one bisection step after the other."""
    df = df.withColumn("_range", F.lit(0))
    if found.n < 2:
        return df
    step = 1 << (found.n - 1).bit_length() - 1
    while step:
        on = F.coalesce(F.get(found["keys"], F.col("_range") + (step - 1)) <= F.struct(*order), F.lit(False))
        df = df.withColumn("_range", F.when(on, F.col("_range") + step).otherwise(F.col("_range")))
        step >>= 1
    return df


def _constants(values: Sequence[int]) -> Column:
    """One number per range, looked up by the row's range."""
    listed = F.from_json(F.lit(json.dumps(list(values))), "array<bigint>")
    return F.get(listed, F.col("_range"))


def with_offsets(
    df: DataFrame,
    order: Sequence[str],
    length: Column | None = None,
    groups: Mapping[str, Column] | None = None,
    ranges: int | None = None,
    staged: bool = False,
    ties: bool = False,
) -> DataFrame:
    """Add ``ord`` (dense, from 0) and ``start`` (sum of the lengths before).

    With ``groups`` (columns that never decrease along the order, for example a
    batch number made from ``ord``) also add those columns and ``rel``, the offset
    inside the row's group. The hidden columns ``HIDDEN`` stay for ``cut_blocks``.

    ``df`` is read twice: once for keys and lengths only, which are kept in the
    shared folder, and once in full. With ``staged`` (``df`` is a written table whose
    lengths are cheap) keys are read in place instead. Full rows move in one shuffle, by range.
    Lengths are computed before it; build long id arrays after this call, so that the
    shuffle moves the shorter source text. Nothing of the table reaches the driver but counts
    and, with ``groups``, a few numbers per range.
    """
    order = list(order)
    # A row without a length takes no place, whatever else lies in its range.
    size = F.lit(1) if length is None else F.coalesce(length, F.lit(0))
    sized = df.withColumn("_len", size.cast("bigint"))
    keys = sized.select(*order, "_len")
    seen = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_len"), F.lit(0)).alias("sum")]
    seen.append(F.coalesce(F.max(F.length(F.to_json(F.struct(*order)))), F.lit(0)).alias("key_bytes"))
    if staged:
        seen = keys.agg(*seen).first()
    else:
        counted = Observation()
        keys, seen = cut_lineage(keys.observe(counted, *seen), "keys"), counted.get
    found = _ranges(keys, seen, order, ranges, ties)

    inside = Window.partitionBy("_range").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)

    def place(source: DataFrame) -> DataFrame:
        return (
            _with_range(source, order, found)
            .withColumn("ord", F.row_number().over(inside) - 1)
            .withColumn("start", F.sum("_len").over(running) - F.col("_len"))
            .withColumn("ord", found.of_row("first") + F.col("ord"))
            .withColumn("_lo", found.of_row("lo"))
            .withColumn("_hi", found.of_row("hi"))
            .withColumn("start", F.col("_lo") + F.col("start"))
        )

    if not groups:
        return place(sized).withColumn("_base", F.lit(0).cast("bigint"))

    names = list(groups)
    key = F.struct(*names)

    def runs(source: DataFrame) -> DataFrame:
        """Where the row's group begins inside the row's range."""
        first = ~F.lag(key).over(inside).eqNullSafe(key)
        here = F.when(F.coalesce(first, F.lit(True)), F.struct("ord", "start"))
        return place(source).withColumns(dict(groups)).withColumn(
            "_here", here
        ).withColumn("_run", F.last("_here", ignorenulls=True).over(running)).drop("_here")

    edges = (
        runs(keys)
        .groupBy("_range")
        .agg(
            F.min_by(F.struct(key.alias("key"), "_run"), "ord").alias("head"),
            F.max_by(F.struct(key.alias("key"), "_run"), "ord").alias("tail"),
        )
        .collect()
    )
    # A group may go on from the range before: give the first run of each range its true base.
    heads, before = [0] * found.n, None
    for e in sorted(edges, key=lambda e: e["_range"]):
        head, tail = e["head"], e["tail"]
        goes_on = before is not None and before[0] == head["key"]
        heads[e["_range"]] = before[1] if goes_on else head["_run"]["start"]
        one_run = tail["_run"]["ord"] == head["_run"]["ord"]
        before = (tail["key"], heads[e["_range"]] if one_run else tail["_run"]["start"])

    in_head = F.col("_run.ord") == found.of_row("first")
    return (
        runs(sized)
        .withColumn("_base", F.when(in_head, _constants(heads)).otherwise(F.col("_run.start")))
        .withColumn("rel", F.col("start") - F.col("_base"))
        .drop("_run")
    )


def with_ordinal(
    df: DataFrame,
    order: Sequence[str],
    name: str = "ord",
    ranges: int | None = None,
    staged: bool = False,
    ties: bool = False,
) -> DataFrame:
    """Add a dense ordinal from 0 in the given order."""
    out = with_offsets(df, order, ranges=ranges, staged=staged, ties=ties).drop("start", *HIDDEN)
    return out if name == "ord" else out.withColumnRenamed("ord", name)
