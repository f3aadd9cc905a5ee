"""Append-only log of run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "run_id bigint, step bigint, ts timestamp, metric string, value double"


def append_run_log(df: DataFrame, path: str) -> None:
    columns = [part.split()[0] for part in SCHEMA.split(", ")]
    df.select(*columns).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
