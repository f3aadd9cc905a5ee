"""Scans, slices, shards, samples, logs, budgets and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import ids as I
from ...operators import loader, quality, sequences
from ...session import scratch_path
from ...sources import append_run_log, assemble, read_corpus, read_media, read_media_parts, read_run_log
from ...sources import split_slice, union_shards, write_shards
from .registry import query, sql_bytes, table, utc


@query(
    "corpus_scan_pruned",
    """SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000""",
)
def corpus_scan_pruned(spark, sf_dir):
    df = read_corpus(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "n_chars"])
    return df.where(F.col("n_chars") > 1000)


@query(
    "split_slice_head",
    """SELECT doc_id, lang, md5(text) AS digest FROM documents ORDER BY doc_id LIMIT 10""",
)
def split_slice_head(spark, sf_dir):
    df = split_slice(table(spark, sf_dir, "documents"), ["doc_id"], None, 10)
    return df.select("doc_id", "lang", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(
    "split_slice_percent",
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM documents)
    SELECT doc_id, source, n_chars FROM o
    WHERE o >= floor(n * 20.0 / 100 + 0.5) AND o < floor(n * 60.0 / 100 + 0.5)""",
)
def split_slice_percent(spark, sf_dir):
    df = split_slice(table(spark, sf_dir, "documents"), ["doc_id"], 20, 60, "percent")
    return df.select("doc_id", "source", "n_chars")


def _sharded(spark, sf_dir):
    path = scratch_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path, ["doc_id"], 5)
    return path


@query(
    "shard_counts",
    """WITH o AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) * 5 // count(*) OVER () AS shard FROM documents)
    SELECT shard::INT AS shard, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc
    FROM o GROUP BY shard""",
)
def shard_counts(spark, sf_dir):
    return (
        spark.read.parquet(_sharded(spark, sf_dir))
        .groupBy("shard")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("last_doc"),
        )
    )


@query(
    "union_shards",
    """SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM (
      SELECT * FROM documents UNION ALL SELECT * FROM documents
    ) GROUP BY lang""",
)
def union_of_shards(spark, sf_dir):
    path = _sharded(spark, sf_dir)
    shards = [spark.read.parquet(f"{path}/shard={i}") for i in range(5)]
    # Each shard twice: a union keeps duplicates.
    return (
        union_shards(shards + shards)
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))
    )


# A file for every thousand ids of a language, with a line for each document.
@query(
    "media_scan",
    """WITH l AS (SELECT lang, doc_id // 1000 AS chunk,
        string_agg(doc_id || ':' || md5(text) || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY ALL)
    SELECT lang, chunk, octet_length(encode(content))::BIGINT AS length, md5(content) AS digest FROM l""",
)
def media_scan(spark, sf_dir):
    files = read_media(spark, _media_files(spark, sf_dir), pattern="*.txt")
    return files.select(*_media_names(), "length", F.md5("content").alias("digest"))


def _media_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.md5(F.encode("text", "UTF-8"))).alias("value")
    lines = docs.select("lang", F.expr("doc_id div 1000").alias("chunk"), "doc_id", line)
    path = scratch_path(spark, "media")
    (
        lines.repartition("lang", "chunk")
        .sortWithinPartitions("lang", "chunk", "doc_id")
        .drop("doc_id")
        .write.partitionBy("lang", "chunk")
        .text(path)
    )
    return path


def _media_names():
    return (
        F.regexp_extract("path", "/lang=([^/]+)/", 1).alias("lang"),
        F.regexp_extract("path", "/chunk=([0-9]+)/", 1).cast("bigint").alias("chunk"),
    )


# The same files in ranges of a kilobyte; all their characters are ASCII.
@query(
    "media_parts",
    """WITH l AS (SELECT lang, doc_id // 1000 AS chunk,
        string_agg(doc_id || ':' || md5(text) || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY ALL),
      p AS (SELECT *, unnest(range(0, length(content), 1024)) AS start FROM l)
    SELECT lang, chunk, length(content)::BIGINT AS length, start // 1024 AS part_no, start,
      md5(content[start + 1:start + 1024]) AS digest FROM p""",
)
def media_parts(spark, sf_dir):
    parts = read_media_parts(
        spark, _media_files(spark, sf_dir), pattern="*.txt", part_bytes=1024, parts_per_task=1024
    )
    return parts.select(*_media_names(), "length", "part_no", "start", F.md5("content").alias("digest"))


@query(
    "sample_assembly",
    """SELECT d.doc_id AS sample_id, d.n_chars, e.vec_id IS NOT NULL AS has_image, len(e.embedding) AS image_size,
      l.doc_id IS NOT NULL AS has_audio, l.quality, l.toxic
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def sample_assembly(spark, sf_dir):
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "n_chars")
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "embedding")
    audios = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "sample_id")
    return assemble(text, images=images, audios=audios).select(
        "sample_id",
        "n_chars",
        F.col("image").isNotNull().alias("has_image"),
        F.when(F.col("image").isNotNull(), F.size("image.embedding")).alias("image_size"),
        F.col("audio").isNotNull().alias("has_audio"),
        "audio.quality",
        "audio.toxic",
    )


@query(
    "run_log_scan",
    """SELECT event_type AS metric, count(*) AS n, count(DISTINCT user_id) AS n_runs, max(event_id) AS last_step,
      round(avg(value), 6) AS mean_value FROM events GROUP BY event_type""",
)
def run_log_scan(spark, sf_dir):
    path = scratch_path(spark, "run-log")
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        utc("ts").alias("ts"),
        F.col("event_type").alias("metric"),
        "value",
    )
    # Two appends, as from two runs.
    append_run_log(log.where(F.col("step") % 2 == 0), path)
    append_run_log(log.where(F.col("step") % 2 == 1), path)
    return (
        read_run_log(spark, path)
        .groupBy("metric")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("run_id").alias("n_runs"),
            F.max("step").alias("last_step"),
            F.round(F.avg("value"), 6).alias("mean_value"),
        )
    )


@query(
    "length_budget",
    f"""WITH b AS (SELECT lang, len({sql_bytes('text')}) + 2 AS n FROM documents)
    SELECT lang, n + 66 <= 2048 AS fits, count(*) AS n_docs, sum(n)::BIGINT AS n_ids, max(n + 66)::INT AS longest
    FROM b GROUP BY ALL""",
)
def length_budget(spark, sf_dir):
    # Bytes, begin and end mark; the ids themselves are not needed.
    df = table(spark, sf_dir, "documents").select("lang", "text")
    return (
        sequences.length_budget(df, length=I.byte_count("text") + 2)
        .groupBy("lang", "fits")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum("n_ids").alias("n_ids"),
            F.max("total_len").alias("longest"),
        )
    )


@query(
    "drop_consumed",
    f"""SELECT doc_id, lang, source, n_chars, {"len(" + sql_bytes("text") + ")"}::INT AS n_ids FROM documents""",
)
def drop_consumed(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumn("n_ids", I.byte_count("text").cast("int"))
    return df.drop("text")


@query(
    "modality_presence",
    """SELECT d.lang, count(*) AS n, count(e.vec_id) AS n_image, 0::BIGINT AS n_audio, count(*) FILTER (e.label > 4) AS n_video
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.lang""",
)
def modality_presence(spark, sf_dir):
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    df = assemble(text, images=images)
    df = df.withColumn("audio", F.col("image")).withColumn(
        "video", F.when(F.col("image.label") > 4, F.col("image"))
    )
    enabled = ["text", "image", "video"]
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if(sequences.has_modality(m, enabled)).alias(f"n_{m}")
            for m in ("image", "audio", "video")
        ],
    )


@query(
    "require_valid",
    """SELECT lang, count(*) AS n, min(n_chars) AS least FROM documents GROUP BY lang""",
)
def require_valid(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    checked = quality.require(df, F.col("n_chars") == F.length("text"), "n_chars is wrong")
    return checked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"))


@query(
    "resume_skip",
    """WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id, n_chars FROM documents)
    SELECT batch_id, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars FROM b WHERE batch_id >= 5 GROUP BY batch_id""",
)
def resume_skip(spark, sf_dir):
    df = loader.with_batch(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], 8)
    return (
        loader.skip_first_batches(df, 5)
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))
    )


@query(
    "log_cadence",
    """SELECT event_id AS step, value AS loss, event_id % 1000 = 0 AND event_id > 0 AS checkpoints
    FROM events WHERE event_id % 100 = 0 AND event_id < 9000""",
)
def log_cadence(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.col("value").alias("loss")
    )
    saved = loader.on_cadence("step", 1000, include_zero=False)
    return loader.at_cadence(log, 100, 9000).select("step", "loss", saved.alias("checkpoints"))
