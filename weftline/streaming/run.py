"""Run a stream over what has arrived and read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path


def progress_path(path: str) -> str:
    """Where the progress and the state of the query that writes ``path`` are kept."""
    return f"{path}-progress"


def run_to_parquet(sdf: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Process all available input in append mode into a parquet table.

    Results go to ``path`` and progress beside it: called again with the same path, the
    query goes on where it stopped and adds what is new. Without a path the table is a new one
    in the shared folder.
    """
    spark = sdf.sparkSession
    out = scratch_path(spark, name) if path is None else path
    query = (
        sdf.writeStream.format("parquet")
        .option("checkpointLocation", progress_path(out))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)
