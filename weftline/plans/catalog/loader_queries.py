"""Ordinals, packing, batches, rank shards, steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import ids as I
from ...operators import loader, packing
from ...operators.ordering import with_ordinal
from ...session import scratch_path
from ...sources.manifest import read_table, union_tables, write_table
from ..corpus import byte_length, corpus_blocks, corpus_to_ranks
from .registry import query, sql_bytes, sql_digest, table

BLOCK = 2048
BATCH_ROWS = 100


@query(
    "row_ordinal",
    """SELECT doc_id, source, (row_number() OVER (ORDER BY source, n_chars, doc_id) - 1) AS ord FROM documents""",
)
def row_ordinal(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return with_ordinal(df, ["source", "n_chars", "doc_id"], staged=True).drop("n_chars")


def _pack_sql(block: int, batch_rows: int) -> str:
    return f"""WITH d AS (SELECT doc_id, list_append({sql_bytes("text")}, 2) AS ids,
        (row_number() OVER (ORDER BY doc_id) - 1) // {batch_rows} AS batch_id FROM documents),
      t AS (SELECT batch_id, unnest(ids) AS id, doc_id, generate_subscripts(ids, 1) AS k FROM d),
      q AS (SELECT batch_id, id, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id, k) - 1 AS place,
        count(*) OVER (PARTITION BY batch_id) AS total FROM t)
    SELECT batch_id, place // {block} AS block_no, count(*)::INT AS n_ids, md5(string_agg(id, ',' ORDER BY place)) AS digest,
      count(*)::INT AS mask_ones
    FROM q WHERE total < {block} OR place < total // {block} * {block} GROUP BY ALL"""


def _pack(spark, sf_dir, block, batch_rows):
    blocks = corpus_blocks(table(spark, sf_dir, "documents"), block, batch_rows)
    return blocks.select(
        "batch_id",
        "block_no",
        F.size("input_ids").alias("n_ids"),
        I.checksum("input_ids").alias("digest"),
        F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("mask_ones"),
    )


@query("pack_batches", _pack_sql(BLOCK, BATCH_ROWS))
def pack_batches(spark, sf_dir):
    return _pack(spark, sf_dir, BLOCK, BATCH_ROWS)


# Single-document batches: most are shorter than a block and stay short.
@query("pack_short_batches", _pack_sql(4096, 1))
def pack_short_batches(spark, sf_dir):
    return _pack(spark, sf_dir, 4096, 1)


@query(
    "pack_global",
    f"""WITH d AS (SELECT doc_id, list_append({sql_bytes("text")}, 2) AS ids FROM documents),
      t AS (SELECT unnest(ids) AS id, doc_id, generate_subscripts(ids, 1) AS k FROM d),
      q AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS place, count(*) OVER () AS total FROM t)
    SELECT place // {BLOCK} AS block_no, count(*)::INT AS n_ids, md5(string_agg(id, ',' ORDER BY place)) AS digest
    FROM q WHERE place < total // {BLOCK} * {BLOCK} GROUP BY ALL""",
)
def pack_global(spark, sf_dir):
    blocks = corpus_blocks(table(spark, sf_dir, "documents"), BLOCK, None)
    return blocks.select(
        "block_no", F.size("input_ids").alias("n_ids"), I.checksum("input_ids").alias("digest")
    )


# Documents without a text have the end mark alone.
@query(
    "pack_null_text",
    f"""WITH d AS (SELECT list_append({sql_bytes("coalesce(t, '')")}, 2) AS ids, doc_id
        FROM (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN text END AS t FROM documents)),
      t AS (SELECT unnest(ids) AS id, doc_id, generate_subscripts(ids, 1) AS k FROM d),
      q AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS place, count(*) OVER () AS total FROM t)
    SELECT place // {BLOCK} AS block_no, count(*)::INT AS n_ids, md5(string_agg(id, ',' ORDER BY place)) AS digest
    FROM q WHERE place < total // {BLOCK} * {BLOCK} GROUP BY ALL""",
)
def pack_null_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("text"))
    blocks = corpus_blocks(docs, BLOCK, None)
    return blocks.select("block_no", F.size("input_ids").alias("n_ids"), I.checksum("input_ids").alias("digest"))


RANKS, RANK_BATCH = 4, 3


def _ranks_sql(even: bool) -> str:
    total = f"ceil(n / {RANKS}.0)::BIGINT * {RANKS}" if even else "n"
    return f"""WITH d AS (SELECT doc_id, list_append({sql_bytes("text")}, 2) AS ids FROM documents),
      t AS (SELECT unnest(ids) AS id, doc_id, generate_subscripts(ids, 1) AS k FROM d),
      q AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS place, count(*) OVER () AS total FROM t),
      b AS (SELECT place // {BLOCK} AS block_no, md5(string_agg(id, ',' ORDER BY place)) AS digest
        FROM q WHERE place < total // {BLOCK} * {BLOCK} GROUP BY ALL),
      n AS (SELECT max(block_no) // {RANK_BATCH} + 1 AS n FROM b),
      r AS (SELECT unnest(range({total})) AS batch, n FROM n)
    SELECT (batch % {RANKS})::INT AS rank, batch // {RANKS} AS local_step, (block_no % {RANK_BATCH})::INT AS row_no, digest
    FROM r JOIN b ON block_no // {RANK_BATCH} = batch % n"""


def _ranks(even: bool):
    def query_fn(spark, sf_dir):
        out = corpus_to_ranks(table(spark, sf_dir, "documents"), RANKS, RANK_BATCH, BLOCK, even)
        rows = out.select("rank", "local_step", F.posexplode("input_ids").alias("row_no", "ids"))
        return rows.select("rank", "local_step", "row_no", I.checksum("ids").alias("digest"))

    return query_fn


query("corpus_to_ranks", _ranks_sql(False))(_ranks(False))
query("corpus_to_ranks_even", _ranks_sql(True))(_ranks(True))


@query(
    "pack_by_source",
    f"""WITH d AS (SELECT source, doc_id, list_append({sql_bytes("text")}, 2) AS ids FROM documents),
      t AS (SELECT source, unnest(ids) AS id, doc_id, generate_subscripts(ids, 1) AS k FROM d),
      q AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, k) - 1 AS place FROM t)
    SELECT source, place // {BLOCK} AS block_no, count(*)::INT AS n_ids, md5(string_agg(id, ',' ORDER BY place)) AS digest
    FROM q GROUP BY ALL""",
)
def pack_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    blocks = packing.pack_by_key(
        docs,
        ["source"],
        ["chars"],
        BLOCK,
        ["doc_id"],
        byte_length(),
        {"chars": I.byte_chars("text")},
        chars=True,
    )
    blocks = blocks.withColumn("input_ids", packing.char_ids("chars"))
    return blocks.select(
        "source", "block_no", F.size("input_ids").alias("n_ids"), I.checksum("input_ids").alias("digest")
    )


@query(
    "pack_report",
    f"""WITH d AS (SELECT octet_length(encode(text)) + 1 AS n, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH_ROWS} AS batch_id
        FROM documents),
      b AS (SELECT batch_id, count(*) AS n_rows, sum(n)::BIGINT AS n_in FROM d GROUP BY batch_id),
      r AS (SELECT *, CASE WHEN n_in < {BLOCK} THEN n_in ELSE n_in // {BLOCK} * {BLOCK} END AS n_kept FROM b)
    SELECT batch_id, grouping(batch_id)::INT AS is_total, sum(n_rows)::BIGINT AS n_rows, sum(n_in)::BIGINT AS n_in,
      sum(n_kept)::BIGINT AS n_kept, sum(n_in - n_kept)::BIGINT AS n_dropped,
      sum(CASE WHEN n_in < {BLOCK} THEN 0 ELSE n_in // {BLOCK} END)::BIGINT AS full_blocks,
      sum(CASE WHEN n_in < {BLOCK} AND n_in > 0 THEN 1 ELSE 0 END)::BIGINT AS short_blocks
    FROM r GROUP BY ROLLUP (batch_id)""",
)
def pack_report(spark, sf_dir):
    return packing.pack_report(table(spark, sf_dir, "documents"), byte_length(), BLOCK, BATCH_ROWS)


@query(
    "loader_batches",
    """WITH b AS (SELECT vec_id, embedding, label, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch_id FROM embeddings)
    SELECT batch_id, count(*)::INT AS n_rows, array_to_string(list(vec_id ORDER BY vec_id), ',') AS vec_ids,
      array_to_string(list(label ORDER BY vec_id), ',') AS labels,
      round(sum(embedding[1]::DOUBLE), 6) AS first_dim FROM b GROUP BY batch_id""",
)
def loader_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("ids", F.array("vec_id"))
    b = loader.to_batches(rows, ["vec_id"], ["embedding", "ids"], 32)
    labels = loader.to_batches(rows, ["vec_id"], ["label"], 32, same_size=False)
    return b.join(labels.drop("n_rows"), "batch_id").select(
        "batch_id",
        "n_rows",
        F.array_join(F.flatten("ids").cast("array<string>"), ",").alias("vec_ids"),
        F.array_join(F.col("label").cast("array<string>"), ",").alias("labels"),
        F.round(
            F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v[0].cast("double")), 6
        ).alias("first_dim"),
    )


_DOC_BATCHES = "b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 7 AS batch_id, n_chars FROM documents)"


@query(
    "rank_shards",
    f"""WITH {_DOC_BATCHES} SELECT (batch_id % 4)::INT AS rank, batch_id // 4 AS local_step, count(*) AS n_rows,
      sum(n_chars)::BIGINT AS n_chars FROM b GROUP BY ALL""",
)
def rank_shards(spark, sf_dir):
    df = loader.with_batch(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], 7)
    path = scratch_path(spark, "ranks")
    loader.write_ranks(loader.shard_batches(df, 4), path)
    return (
        spark.read.parquet(path)
        .groupBy("rank", "local_step")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))
    )


@query(
    "rank_resume",
    f"""WITH {_DOC_BATCHES} SELECT (batch_id % 4)::INT AS rank, batch_id // 4 AS local_step, count(*) AS n_rows,
      sum(n_chars)::BIGINT AS n_chars FROM b WHERE batch_id // 4 >= 9 GROUP BY ALL""",
)
def rank_resume(spark, sf_dir):
    """Ranks written with a manifest; after nine steps, only files with later steps are opened."""
    df = loader.with_batch(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], 7)
    path = scratch_path(spark, "ranks")
    write_table(loader.shard_batches(df, 4), path, "local_step", keys_per_file=16, by=["rank"])
    return (
        read_table(spark, path, first=9)
        .groupBy("rank", "local_step")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))
    )


@query(
    "tokenized_shards",
    f"""WITH d AS (SELECT lang, list_append({sql_bytes("text")}, 2) AS ids, doc_id FROM documents),
      t AS (SELECT lang, unnest(ids) AS id, doc_id, generate_subscripts(ids, 1) AS k FROM d),
      p AS (SELECT lang, id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id, k) - 1) // {BLOCK} AS block_no FROM t),
      b AS (SELECT lang, block_no, count(*) AS n, sum(id) AS ids FROM p GROUP BY ALL)
    SELECT lang, count(*) AS n_blocks, sum(n)::BIGINT AS n_ids, sum(ids)::BIGINT AS sum_ids FROM b WHERE n = {BLOCK} GROUP BY lang""",
)
def tokenized_shards(spark, sf_dir):
    """Blocks of each language, in one table for those before ``es`` and one for the rest; checked and united."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    build = {"_chars": I.byte_chars(F.coalesce("text", F.lit("")))}
    early = F.coalesce(F.col("lang") < "es", F.lit(False))
    paths = []
    for some in (docs.where(early), docs.where(~early)):
        blocks = packing.pack_by_key(some, ["lang"], ["_chars"], BLOCK, ["doc_id"], byte_length(), build, chars=True)
        full = blocks.where(F.char_length("_chars") == BLOCK)
        full = full.select("lang", "block_no", packing.char_ids("_chars").alias("input_ids"))
        paths.append(scratch_path(spark, "blocks"))
        write_table(full, paths[-1], "block_no", keys_per_file=4096)
    return (
        union_tables(spark, paths, verify=True)
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("n_blocks"),
            F.sum(F.size("input_ids")).alias("n_ids"),
            F.sum(F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("sum_ids"),
        )
    )


@query(
    "rank_shards_even",
    f"""WITH {_DOC_BATCHES}, n AS (SELECT max(batch_id) + 1 AS n FROM b),
      ids AS (SELECT unnest(range((n + 15) // 16 * 16)) AS id, n FROM n)
    SELECT (id % 16)::INT AS rank, id // 16 AS local_step, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars
    FROM ids JOIN b ON b.batch_id = id % n GROUP BY ALL""",
)
def rank_shards_even(spark, sf_dir):
    df = loader.with_batch(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], 7)
    return (
        loader.shard_batches(df, 16, even=True)
        .groupBy("rank", "local_step")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))
    )


@query(
    "step_plan",
    """WITH n AS (SELECT count(*) AS n FROM documents)
    SELECT n AS n_batches, ceil(n / 4.0::DOUBLE)::BIGINT AS max_steps, ceil(n / 8.0::DOUBLE)::BIGINT AS batches_per_rank,
      ceil(ceil(n / 8.0::DOUBLE) / 4.0::DOUBLE)::BIGINT AS max_steps_per_rank,
      floor(ceil(n / 4.0::DOUBLE) * 0.01::DOUBLE)::BIGINT AS warmup_steps, 32::BIGINT AS total_batch FROM n""",
)
def step_plan(spark, sf_dir):
    return loader.step_plan(table(spark, sf_dir, "documents").select("doc_id"), batch=1, world=8, accum=4)


@query(
    "accumulate_steps",
    """SELECT user_id AS run_id, event_id // 16 AS opt_step, count(*) AS n_batches, round(avg(value), 6) AS mean_loss
    FROM events GROUP BY ALL""",
)
def accumulate_steps(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("loss")
    )
    out = loader.accumulate(log, 16, by=["run_id"])
    return out.withColumn("mean_loss", F.round("mean_loss", 6))


_NAMES = """n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'step_' || event_id WHEN 1 THEN 'out/step_' || event_id || '.pt'
  WHEN 2 THEN 'final/epoch_' || event_id ELSE 'run.1/step_' || event_id END AS name FROM events)"""


def _checkpoint_names(spark, sf_dir):
    step = F.col("event_id").cast("string")
    kind = F.col("event_id") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("step_"), step))
        .when(kind == 1, F.concat(F.lit("out/step_"), step, F.lit(".pt")))
        .when(kind == 2, F.concat(F.lit("final/epoch_"), step))
        .otherwise(F.concat(F.lit("run.1/step_"), step))
    )
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"))


@query(
    "resume_step",
    f"""WITH {_NAMES} SELECT event_id, name, CASE WHEN name LIKE '%step_%' THEN event_id END AS completed_steps,
      CASE WHEN name LIKE '%step_%' THEN event_id * 4 END AS batches_to_skip FROM n""",
)
def resume_step(spark, sf_dir):
    return loader.resume_step(_checkpoint_names(spark, sf_dir), accum=4)


@query(
    "latest_checkpoint",
    f"""WITH {_NAMES} SELECT arg_max(name, event_id) AS name, max(event_id) AS completed_steps,
      max(event_id) * 4 AS batches_to_skip FROM n WHERE name LIKE '%step_%'""",
)
def latest_checkpoint(spark, sf_dir):
    return loader.latest_checkpoint(_checkpoint_names(spark, sf_dir), accum=4)
