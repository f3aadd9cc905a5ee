"""Registration of queries, and the expressions that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ...sources import read_corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The corpus for work on its texts."""
    return read_corpus(spark, f"{sf_dir}/documents.parquet", columns, spread=True)


# The same expressions in SQL.
def sql_bytes(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda h: ('0x' || h)::INTEGER + 12)"
    )


def sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+')"


def sql_digest(items: str) -> str:
    return f"md5(array_to_string({items}, ','))"


# Derived file names: known, unknown, doubled, missing and mixed-case extensions.
SUFFIXES = [
    ".jpg", ".JPEG", ".png", ".bmp", ".wav", ".Mp3", ".ogg", ".txt", ".md", ".JSON",
    ".mp4", ".avi", ".mkv", ".mov", ".csv", ".pdf", "", ".xyz", ".tar.gz",
]


def derived_path() -> Column:
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int")
    )
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix)


SQL_PATH = (
    "source || '/' || doc_id::VARCHAR || (["
    + ", ".join(f"'{s}'" for s in SUFFIXES)
    + f"])[(doc_id % {len(SUFFIXES)})::INT + 1]"
)

SQL_EXTENSION = r"lower(regexp_extract(path, '[^/.][^/]*(\.[^./]*)$', 1))"

SQL_MODALITY = f"""CASE
  WHEN {SQL_EXTENSION} IN ('.jpg', '.jpeg', '.png', '.bmp') THEN 'image'
  WHEN {SQL_EXTENSION} IN ('.wav', '.mp3', '.ogg') THEN 'audio'
  WHEN {SQL_EXTENSION} IN ('.txt', '.md', '.json') THEN 'text'
  WHEN {SQL_EXTENSION} IN ('.mp4', '.avi', '.mkv', '.mov') THEN 'video'
  WHEN {SQL_EXTENSION} = '.csv' THEN 'csv'
  WHEN {SQL_EXTENSION} = '.pdf' THEN 'pdf' END"""


def utc(column: str) -> Column:
    """A TIMESTAMP_NTZ column as a timestamp of the session's time zone."""
    return F.col(column).cast("timestamp")
