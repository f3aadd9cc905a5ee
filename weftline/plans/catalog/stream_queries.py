"""Streams over the given tables, run until all input is taken."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import ids as I
from ...operators.packing import char_ids
from ...session import scratch_path
from ...streaming import encode_stream, log_windows, pack_stream, run_to_parquet, stream_tails
from .registry import query, sql_bytes, sql_digest, table, utc

STREAM_BLOCK = 1024
#: Bytes of text in an arriving file, and files in a micro-batch, of which there are four at least.
FILE_BYTES, BATCH_FILES = 64 << 20, 4


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    # A stream reads what a pattern matches: here one file, or one folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query(
    "stream_encode",
    f"""WITH e AS (SELECT doc_id, list_concat([0], {sql_bytes("text")}, [2])[1:1984] AS ids FROM documents),
      s AS (SELECT doc_id, list_concat(ids[1:1], [4, 5], ids[2:]) AS x FROM e)
    SELECT doc_id, len(x)::INT AS n_ids, {sql_digest("x")} AS digest, len(x)::INT AS mask_ones FROM s""",
)
def stream_encode(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    out = run_to_parquet(encode_stream(docs, max_len=1984, media=["image"]), "stream-encode")
    return out.select(
        "doc_id",
        F.size("input_ids").alias("n_ids"),
        I.checksum("input_ids").alias("digest"),
        F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("mask_ones"),
    )


@query(
    "stream_windows",
    """WITH w AS (SELECT date_trunc('hour', ts) AS h, * FROM events), m AS (SELECT max(ts) AS m FROM events)
    SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS sum_value,
      min(value) AS min_value, max(value) AS max_value
    FROM w, m WHERE h + INTERVAL 1 HOUR <= date_trunc('millisecond', m) - INTERVAL 2 HOUR GROUP BY ALL""",
)
def stream_windows(spark, sf_dir):
    log = _stream(spark, sf_dir, "events").withColumn("ts", utc("ts"))
    windows = log_windows(log, "1 hour", "2 hours", by=["event_type"])
    out = run_to_parquet(windows, "stream-windows")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "event_type",
        "n",
        F.round("sum_value", 4).alias("sum_value"),
        "min_value",
        "max_value",
    )


# Several micro-batches; the rest of each lane comes from the state. The order is that of
# arrival, so contents are compared without it.
@query(
    "stream_pack",
    f"""WITH d AS (SELECT source, doc_id % 4 AS lane, list_append({sql_bytes("text")}, 2) AS ids FROM documents),
      t AS (SELECT source, lane, sum(len(ids))::BIGINT AS n_ids, sum(list_sum(ids))::BIGINT AS sum_ids,
        sum(list_sum(list_transform(ids, lambda x: x * x)))::BIGINT AS sum_squares FROM d GROUP BY ALL)
    SELECT source, lane::INT AS lane, n_ids // {STREAM_BLOCK} AS n_blocks, n_ids, ceil(n_ids / {STREAM_BLOCK}.0)::BIGINT - 1 AS last_block,
      n_ids % {STREAM_BLOCK} AS n_tail, sum_ids, sum_squares FROM t""",
)
def stream_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", I.byte_chars("text").alias("chars"))
    arriving, path = scratch_path(spark, "arriving"), scratch_path(spark, "stream-pack")
    n_bytes = table(spark, sf_dir, "documents").agg(F.sum(I.byte_count("text"))).first()[0] or 0
    n_files = max(4, -(-n_bytes // FILE_BYTES))
    docs.repartition(n_files, "doc_id").write.parquet(arriving)
    at_once = min(BATCH_FILES, n_files // 4)
    live = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", at_once).parquet(arriving)
    packed = pack_stream(live, "source", STREAM_BLOCK, "chars", lane=F.col("doc_id") % 4)
    blocks = run_to_parquet(packed, "stream-pack", path).unionByName(stream_tails(spark, path, "source", "chars"))
    blocks = blocks.withColumn("ids", char_ids("chars"))
    size = F.size("ids")
    full = size == STREAM_BLOCK
    return blocks.groupBy("source", "lane").agg(
        F.countDistinct(F.when(full, F.col("block_no"))).alias("n_blocks"),
        F.sum(size).alias("n_ids"),
        F.max("block_no").alias("last_block"),
        F.sum(F.when(full, 0).otherwise(size)).alias("n_tail"),
        F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("sum_ids"),
        F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x * x)).alias("sum_squares"),
    )
