"""Media files as binary rows, whole or in byte ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LISTING = ("path", "modificationTime", "length")

#: Content of one row, unless the caller sets another bound.
MAX_BYTES = 256 << 20
PART_BYTES = 16 << 20
PARTS_PER_TASK = 8


def _files(spark: SparkSession, paths: tuple[str, ...], pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(list(paths))


def read_media(spark: SparkSession, *paths: str, pattern: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, modificationTime, length, content`` of every file that is not empty.

    Select the ``LISTING`` columns to list files without reading their content. Content of a
    file above ``max_bytes`` is an error, raised before the file is opened: one row would
    hold it whole. Read such files with ``read_media_parts``.
    """
    files = _files(spark, paths, pattern)
    # The source applies a filter on the length before it opens a file.
    short = files.where(F.col("length") <= int(max_bytes))
    refused = F.raise_error(F.concat(F.col("path"), F.lit(f" has more than {int(max_bytes)} bytes; read it in parts")))
    long = files.where(F.col("length") > int(max_bytes)).select(*LISTING, refused.cast("binary").alias("content"))
    return short.unionByName(long)


def open_path(path: str) -> BinaryIO:
    """The file of a listed path, by Arrow's file systems (local, hdfs, s3, gs, abfs)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        local = rest if colon else path
        return fs.LocalFileSystem().open_input_file("/" + local.lstrip("/"))
    store, _, name = rest.removeprefix("//").partition("/")
    system, root = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{store}/")
    return system.open_input_file(f"{root.rstrip('/')}/{name}")


def read_media_parts(
    spark: SparkSession,
    *paths: str,
    pattern: str | None = None,
    where: Column | None = None,
    part_bytes: int = PART_BYTES,
    parts_per_task: int = PARTS_PER_TASK,
    open_file: Callable[[str], BinaryIO] = open_path,
) -> DataFrame:
    """``path, length, part_no, start, content``: every file in ranges of ``part_bytes``.

    A file of any length is read by as many tasks as it has parts over ``parts_per_task``,
    and a task holds one part at a time. Files are listed by
    Spark, which leaves out empty ones; ``pattern`` and a condition ``where`` on ``path``, ``length`` or ``modificationTime``
    leave files out before any is opened. ``open_file`` opens a listed path inside a task,
    for stores that Arrow does not know. A file that has become shorter since it was
    listed is an error.
    """
    size = int(part_bytes)
    if size < 1 or parts_per_task < 1:
        raise ValueError("part_bytes and parts_per_task must be positive")
    files = _files(spark, paths, pattern).select(*LISTING)
    files = (files if where is None else files.where(where)).select("path", "length")
    last = F.expr(f"(length - 1) div {size}")
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part_no"))
    n_parts = files.agg(F.sum(last + 1)).first()[0] or 0
    # A listing is small whatever the files hold, so tasks are made by parts and not by its bytes.
    dealt = parts.withColumn("start", F.col("part_no") * size).repartition(max(1, -(-n_parts // int(parts_per_task))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                wanted = min(size, row["length"] - row["start"])
                with open_file(row["path"]) as file:
                    file.seek(row["start"])
                    content = file.read(wanted)
                if len(content) < wanted:
                    raise EOFError(f"{row['path']} ends before its listed length of {row['length']}")
                yield batch.slice(i, 1).append_column("content", pa.array([content], pa.binary()))

    return dealt.mapInArrow(run, "path string, length bigint, part_no bigint, start bigint, content binary")
