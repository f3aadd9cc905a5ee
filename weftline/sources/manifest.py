"""Tables in files of consecutive keys, with a manifest that is written last.

A table of blocks or batches is a folder with data files and a manifest: for each file its
rows, first and last key, and a checksum of its rows. The manifest is made from what was
written and appears when all of it is complete; readers open only files that it names. So a
run that dies between files leaves no table, its files are never read, and the run can simply be
repeated. A reader that wants the keys from some number on opens the files that hold them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage

#: The row without a file has the totals and the schema of the table.
MANIFEST = "file string, rows bigint, first bigint, last bigint, checksum bigint, key string, by array<string>, schema string, data string"


def _by_file(spark: SparkSession, path: str, data: str, files: Sequence[str] | None, schema: StructType, key: str) -> DataFrame:
    """``file``, ``rows``, ``first``, ``last``, ``checksum`` of written files."""
    found = _open(spark, path, data, files, schema)
    # A sum does not depend on the order of rows, and equal rows do not cancel out.
    row = found.select(
        F.substring_index("_metadata.file_path", f"/{data}/", -1).alias("file"),
        F.col(key).cast("bigint").alias("k"),
        F.xxhash64(F.to_json(F.struct(*schema.names), {"ignoreNullFields": "false"})).alias("d"),
    )
    return row.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("k").alias("first"),
        F.max("k").alias("last"),
        F.expr("cast(sum(cast(d as decimal(38, 0))) % 9223372036854775807 as bigint)").alias("checksum"),
    )


def _open(spark: SparkSession, path: str, data: str, files: Sequence[str] | None, schema: StructType) -> DataFrame:
    reader = spark.read.schema(schema).option("basePath", f"{path}/{data}")
    if files is None:
        return reader.parquet(f"{path}/{data}")
    return reader.parquet(*[f"{path}/{data}/{f}" for f in files]) if files else spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, key: str, keys_per_file: int = 1024, by: Sequence[str] = ()) -> None:
    """Write ``df`` in files of ``keys_per_file`` consecutive values of ``key``, apart for each value of ``by``.

    ``key`` is a whole number, not NULL. An existing table is not overwritten.
    """
    spark, by = df.sparkSession, list(by)
    if _header(spark, path) is not None:
        raise ValueError(f"{path} already holds a table")
    if "chunk" in df.columns:
        raise ValueError("the column name chunk is taken by the files")
    data = f"data-{uuid.uuid4().hex}"
    chunk = F.when(F.col(key).isNotNull(), F.expr(f"`{key}` div {int(keys_per_file)}")).otherwise(
        F.raise_error(F.lit(f"{key} is NULL")).cast("bigint")
    )
    parted = df.withColumn("chunk", chunk)
    parted.repartition(*by, "chunk").sortWithinPartitions(*by, "chunk", key).write.partitionBy(*by, "chunk").parquet(f"{path}/{data}")
    # Values of ``by`` come back from the names of folders; the types are those of the rows.
    per_file = _by_file(spark, path, data, None, df.schema, key)
    totals = {
        "key": F.lit(key), "by": F.array(*map(F.lit, by)).cast("array<string>"), "schema": F.lit(df.schema.json()), "data": F.lit(data),
    }
    files = cut_lineage(spark.createDataFrame([], MANIFEST).unionByName(per_file, allowMissingColumns=True), "files")
    header = files.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("first").alias("first"), F.max("last").alias("last")
    ).withColumns(totals)
    manifest = files.unionByName(header, allowMissingColumns=True)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _header(spark: SparkSession, path: str):
    """The row of the whole table, or None where no table is complete."""
    try:
        return read_manifest(spark, path).where("file IS NULL").first()
    except AnalysisException:
        return None


def _described(spark: SparkSession, path: str):
    header = _header(spark, path)
    if header is None:
        raise ValueError(f"{path} holds no complete table")
    return header, StructType.fromJson(json.loads(header["schema"]))


def files_of(spark: SparkSession, path: str, first: int | None = None, stop: int | None = None, **by) -> list[str]:
    """The files that hold keys from ``first`` on and below ``stop``, of the given values of the ``by`` columns."""
    wanted = read_manifest(spark, path).where("file IS NOT NULL")
    if first is not None:
        wanted = wanted.where(F.col("last") >= first)
    if stop is not None:
        wanted = wanted.where(F.col("first") < stop)
    for name, value in by.items():
        wanted = wanted.where(F.concat(F.lit("/"), "file").contains(f"/{name}={value}/"))
    return [r["file"] for r in wanted.select("file").orderBy("first", "file").toLocalIterator()]


def read_table(spark: SparkSession, path: str, first: int | None = None, stop: int | None = None, **by) -> DataFrame:
    """The rows with keys from ``first`` on and below ``stop``; ``by`` gives values of the columns the files are apart for."""
    header, schema = _described(spark, path)
    unknown = set(by) - set(header["by"])
    if unknown:
        raise ValueError(f"the files of {path} are not apart for {', '.join(sorted(unknown))}")
    df = _open(spark, path, header["data"], files_of(spark, path, first, stop, **by), schema)
    # Also below the files: row groups in which no key is wanted are left out by their statistics.
    if first is not None:
        df = df.where(F.col(header["key"]) >= first)
    if stop is not None:
        df = df.where(F.col(header["key"]) < stop)
    return df.select(*schema.names)


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose rows are not those that the manifest was made from: ``file``, ``rows`` then and ``rows_now``."""
    header, schema = _described(spark, path)
    was = read_manifest(spark, path).where("file IS NOT NULL").select("file", "rows", "first", "last", "checksum")
    present = _by_file(spark, path, header["data"], None, schema, header["key"]) if header["rows"] else was.limit(0)
    now = present.select("file", F.struct("rows", "first", "last", "checksum").alias("now"))
    both = was.join(now, "file", "left").withColumn("same", F.struct("rows", "first", "last", "checksum").eqNullSafe(F.col("now")))
    return both.where(~F.col("same")).select("file", "rows", F.coalesce("now.rows", F.lit(0)).alias("rows_now"))


def union_tables(spark: SparkSession, paths: Sequence[str], verify: bool = False) -> DataFrame:
    """All rows of several tables, duplicates kept; one schema, and with ``verify`` undamaged files, or it is an error."""
    schemas = {path: _described(spark, path)[1] for path in paths}
    first = next(iter(schemas.values()))
    for path, schema in schemas.items():
        if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in first]:
            raise ValueError(f"{path} has another schema than {paths[0]}")
        if verify and not damaged_files(spark, path).isEmpty():
            raise ValueError(f"{path} has damaged files")
    return reduce(DataFrame.unionByName, [read_table(spark, path) for path in paths])
