"""Frames, pooling, projection and encoders over the vector table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ...functions import vectors as V
from ...operators import blocked, features, vocabulary
from .registry import query, sql_words, table


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("video_id"),
        (F.col("vec_id") % 10).cast("int").alias("frame_no"),
        (F.col("label") % 3).alias("channel"),
        F.col("embedding").alias("pixels"),
        "vec_id",
        "label",
    )


def _sum(column):
    return F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double"))


@query(
    "normalize_pixels",
    """WITH p AS (SELECT vec_id, label % 3 + 1 AS c, embedding AS e FROM embeddings),
      n AS (SELECT vec_id, list_transform(e, lambda x: (x::DOUBLE / 255 - ([0.43216, 0.394666, 0.37645]::DOUBLE[])[c])
        / ([0.22803, 0.22145, 0.216989]::DOUBLE[])[c]) AS v FROM p)
    SELECT vec_id, round(v[1], 6) AS first_value, round(v[64], 6) AS last_value, round(list_sum(v), 6) AS total FROM n""",
)
def normalize_pixels(spark, sf_dir):
    df = _frames(spark, sf_dir).select("vec_id", V.normalize_pixels("pixels", "channel").alias("v"))
    return df.select(
        "vec_id",
        F.round(F.col("v")[0], 6).alias("first_value"),
        F.round(F.col("v")[63], 6).alias("last_value"),
        F.round(_sum(F.col("v")), 6).alias("total"),
    )


@query(
    "stack_frames",
    """WITH v AS (SELECT vec_id // 10 AS video_id, list(embedding ORDER BY vec_id) AS f FROM embeddings GROUP BY ALL)
    SELECT video_id, len(f)::INT AS n_frames, round(f[1][1]::DOUBLE, 6) AS first_value,
      round(f[len(f)][64]::DOUBLE, 6) AS last_value, round(list_sum(list_transform(f, lambda x, i: i * x[2]::DOUBLE)), 6) AS weighted
    FROM v""",
)
def stack_frames(spark, sf_dir):
    out = features.stack_frames(_frames(spark, sf_dir), ["video_id"], "frame_no", "pixels")
    f = F.col("pixels")
    weighted = F.aggregate(
        F.transform(f, lambda x, i: (i + 1) * x[1].cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return out.select(
        "video_id",
        "n_frames",
        F.round(f[0][0].cast("double"), 6).alias("first_value"),
        F.round(F.element_at(f, -1)[63].cast("double"), 6).alias("last_value"),
        F.round(weighted, 6).alias("weighted"),
    )


@query(
    "stack_long_streams",
    """WITH o AS (SELECT label, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS chunk_no, vec_id
      FROM embeddings)
    SELECT label, chunk_no, count(*)::INT AS n_frames, round(arg_min(embedding[1], vec_id)::DOUBLE, 6) AS first_value,
      round(arg_max(embedding[1], vec_id)::DOUBLE, 6) AS last_value FROM o GROUP BY ALL""",
)
def stack_long_streams(spark, sf_dir):
    out = features.stack_frames(_frames(spark, sf_dir), ["label"], "vec_id", "pixels", chunk_frames=16)
    return out.select(
        "label",
        "chunk_no",
        "n_frames",
        F.round(F.col("pixels")[0][0].cast("double"), 6).alias("first_value"),
        F.round(F.element_at("pixels", -1)[0].cast("double"), 6).alias("last_value"),
    )


_CHANNELS = """c AS (SELECT vec_id // 10 AS video_id, label % 3 AS channel, list(embedding ORDER BY vec_id) AS f
  FROM embeddings GROUP BY ALL)"""


@query(
    "channel_first",
    f"""WITH {_CHANNELS} SELECT video_id, channel, len(f)::INT AS n_frames, round(f[1][1]::DOUBLE, 6) AS first_value,
      round(f[len(f)][1]::DOUBLE, 6) AS last_value FROM c""",
)
def channel_first(spark, sf_dir):
    out = features.channel_first(_frames(spark, sf_dir), "video_id", "frame_no", "channel", "pixels")
    return out.select(
        "video_id",
        "channel",
        "n_frames",
        F.round(F.col("pixels")[0][0].cast("double"), 6).alias("first_value"),
        F.round(F.element_at("pixels", -1)[0].cast("double"), 6).alias("last_value"),
    )


@query(
    "flatten_features",
    f"""WITH {_CHANNELS} SELECT video_id, channel, len(flatten(f))::INT AS n_values,
      round(list_sum(list_transform(flatten(f), lambda x: x::DOUBLE)), 6) AS total,
      round(flatten(f)[len(flatten(f))]::DOUBLE, 6) AS last_value FROM c""",
)
def flatten_features(spark, sf_dir):
    out = features.channel_first(_frames(spark, sf_dir), "video_id", "frame_no", "channel", "pixels")
    flat = features.flatten_features(out, "pixels")
    return flat.select(
        "video_id",
        "channel",
        F.size("pixels").alias("n_values"),
        F.round(_sum(F.col("pixels")), 6).alias("total"),
        F.round(F.element_at("pixels", -1).cast("double"), 6).alias("last_value"),
    )


@query(
    "mean_pool",
    """WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
    SELECT label, dim::INT AS dim, round(avg(v::DOUBLE), 6) AS mean FROM x GROUP BY ALL""",
)
def mean_pool(spark, sf_dir):
    out = features.mean_pool(_frames(spark, sf_dir), ["label"], "pixels")
    return out.select("label", F.posexplode("pixels").alias("dim", "mean")).withColumn(
        "mean", F.round("mean", 6)
    )


# The mean vector of each label is one row of the weight matrix.
_PROJECTED = """WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
    m AS (SELECT label, dim, avg(v::DOUBLE) AS v FROM x GROUP BY ALL),
    w AS (SELECT label AS out_dim, list(v ORDER BY dim) AS w FROM m GROUP BY label)
  SELECT e.vec_id, w.out_dim::INT AS out_dim, round(list_dot_product(e.embedding::DOUBLE[], w.w), 6) AS value
  FROM embeddings e, w"""


def _weights(spark, sf_dir):
    means = features.mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select(F.col("label").alias("out_dim"), F.col("embedding").alias("w"))


def _projected(run):
    def query_fn(spark, sf_dir):
        df = table(spark, sf_dir, "embeddings")
        out = run(df, "embedding", _weights(spark, sf_dir), ["vec_id"])
        return out.select("vec_id", F.posexplode("projected").alias("out_dim", "value")).withColumn(
            "value", F.round("value", 6)
        )

    return query_fn


query("project_features", _PROJECTED)(_projected(features.project))
# A matrix beyond the size check: a kilobyte per slice.
query("project_features_join", _PROJECTED)(_projected(partial(features.project, slice_bytes=1024)))
# A matrix that no executor should hold: blocks of 4 x 24, as for one of any size.
query("project_features_blocked", _PROJECTED)(
    _projected(partial(blocked.project_blocked, block_rows=4, block_cols=24))
)


@query(
    "encode_features",
    """WITH x AS (SELECT vec_id, unnest(range(16)) AS j, embedding AS e FROM embeddings)
    SELECT vec_id, j::INT AS dim, round((e[j * 4 + 1] + e[j * 4 + 2] + e[j * 4 + 3] + e[j * 4 + 4])::DOUBLE / 4, 4) AS value FROM x""",
)
def encode_features(spark, sf_dir):
    def make_predict_fn():
        def predict(batch):
            return batch.reshape(len(batch), 16, 4).mean(axis=2)

        return predict

    df = features.encode_features(table(spark, sf_dir, "embeddings"), "embedding", make_predict_fn, 64)
    return df.select("vec_id", F.posexplode("encoded").alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 4)
    )


def _sql_uniform(part: int) -> str:
    return f"((('0x' || left(md5('42|{part}|' || token || '|' || dim), 13))::BIGINT)::DOUBLE + 0.5) / {1 << 52}.0::DOUBLE"


@query(
    "weight_moments",
    f"""WITH v AS (SELECT DISTINCT unnest({sql_words("text")}) AS token FROM documents),
      p AS (SELECT token, unnest(range(16)) AS dim FROM v),
      x AS (SELECT dim, sqrt(-2.0 * ln({_sql_uniform(1)})) * cos(2.0 * pi() * {_sql_uniform(2)}) * 0.25 AS x FROM p)
    SELECT dim::INT AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x GROUP BY dim""",
)
def weight_moments(spark, sf_dir):
    counts = vocabulary.count_words(table(spark, sf_dir, "documents"))
    ids = counts.select(F.col("token").alias("row"))
    values = features.weight_values(ids, "row", 16)
    return values.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_pop("x"), 6).alias("std"),
    )
