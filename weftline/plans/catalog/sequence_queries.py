"""Padding, markers, masks, encoded samples, slot layouts, interleaving."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import ids as I
from ...operators import loader, sequences
from ..presets import PRESETS
from ..samples import prepare_samples, sample_layout, text_ids
from .registry import query, sql_bytes, sql_digest, table

BATCH = 8


def _samples(spark, sf_dir):
    """Conversation turns as samples in loader batches."""
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), F.col("text").alias("target_text")
    )
    return loader.with_batch(rows, ["sample_id"], BATCH).drop("row_no")


def _sql_samples(max_len: int) -> str:
    """``s``: samples; ``t``: truncated ids; ``p``: padded ids."""
    return f"""s AS (SELECT conv_id * 1000 + turn AS sample_id, text,
        (row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1) // {BATCH} AS batch_id FROM conversations),
      t AS (SELECT sample_id, batch_id, list_concat([0], {sql_bytes("text")}, [2])[1:{max_len}] AS ids FROM s),
      p AS (SELECT sample_id, batch_id, len(ids) AS n, list_concat(ids, list_transform(
        range(max(len(ids)) OVER (PARTITION BY batch_id) - len(ids)), lambda i: 1)) AS ids FROM t)"""


def _sql_spliced(media) -> str:
    listed = ", ".join(str(m) for m in I.markers(media))
    return f"list_concat(ids[1:1], [{listed}], ids[2:])"


@query(
    "truncate_pad",
    f"""WITH {_sql_samples(200)} SELECT sample_id, batch_id, n::INT AS n_ids, len(ids)::INT AS padded,
    {sql_digest("ids")} AS digest FROM p""",
)
def truncate_pad(spark, sf_dir):
    df = text_ids(_samples(spark, sf_dir), "target_text", 200)
    df = df.withColumn("n_ids", F.size("input_ids"))
    return sequences.pad_batch(df, "batch_id").select(
        "sample_id",
        "batch_id",
        "n_ids",
        F.size("input_ids").alias("padded"),
        I.checksum("input_ids").alias("digest"),
    )


def _splice(name: str, media):
    @query(
        name,
        f"""WITH {_sql_samples(1984)}, m AS (SELECT sample_id, {_sql_spliced(media)} AS x FROM p)
        SELECT sample_id, len(x)::INT AS n_ids, {sql_digest("x")} AS digest FROM m""",
    )
    def run(spark, sf_dir):
        df = sequences.pad_batch(text_ids(_samples(spark, sf_dir), "target_text", 1984), "batch_id")
        tokens = I.splice_after_first("input_ids", I.markers(media))
        df = df.select("sample_id", tokens.alias("x"))
        return df.select("sample_id", F.size("x").alias("n_ids"), I.checksum("x").alias("digest"))


_splice("splice_image", ("image",))
_splice("splice_audio", ("image", "audio"))
_splice("splice_video", ("image", "audio", "video"))
_splice("splice_any", ("image", "audio", "video", "any"))


def _mask_sql(preset: str) -> str:
    p = PRESETS[preset]
    ones = f"list_transform(range({p.prefix}), lambda i: 1)"
    body = "list_transform(x, lambda v: (v <> 1)::INT)"
    return f"""WITH {_sql_samples(p.max_len)}, m AS (SELECT sample_id, ids, {_sql_spliced(p.media)} AS x FROM p),
      k AS (SELECT sample_id, ids, x, list_concat({ones}, {body}) AS mask FROM m)
      SELECT sample_id, len(x)::INT AS n_tokens, {sql_digest("x")} AS token_digest, {sql_digest("ids")} AS label_digest,
      len(mask)::INT AS n_mask, list_sum(mask)::BIGINT AS n_ones, {sql_digest("mask")} AS mask_digest FROM k"""


def _encoded(preset: str):
    def run(spark, sf_dir):
        df = prepare_samples(_samples(spark, sf_dir), preset)
        return df.select(
            "sample_id",
            F.size("text_tokens").alias("n_tokens"),
            I.checksum("text_tokens").alias("token_digest"),
            I.checksum("labels").alias("label_digest"),
            F.size("attention_mask").alias("n_mask"),
            F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_ones"),
            I.checksum("attention_mask").alias("mask_digest"),
        )

    return run


query("labels_mask", _mask_sql("image"))(_encoded("image"))
query("mask_no_prefix", _mask_sql("video_optional"))(_encoded("video_optional"))
for _preset in PRESETS:
    query(f"preset_{_preset}", _mask_sql(_preset))(_encoded(_preset))


@query(
    "encoded_sample",
    f"""WITH {_sql_samples(1984)}, m AS (SELECT sample_id, ids, {_sql_spliced(("image", "audio"))} AS x FROM p)
    SELECT sample_id, len(x)::INT AS n_tokens, {sql_digest("ids")} AS label_digest,
      len(e.embedding) AS image_size, round(e.embedding[1]::DOUBLE, 6) AS first_value, NULL::INT AS audio_size
    FROM m LEFT JOIN embeddings e ON e.vec_id = m.sample_id""",
)
def encoded_sample(spark, sf_dir):
    images = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").alias("image"), F.col("embedding").alias("audio")
    )
    df = _samples(spark, sf_dir).join(images, "sample_id", "left")
    # Audio is off, so its column is NULL although there is data.
    out = prepare_samples(
        df, "audio_optional", features={"image": "image", "audio": "audio"}, enabled=["image"]
    )
    return out.select(
        "sample_id",
        F.size("text_tokens").alias("n_tokens"),
        I.checksum("labels").alias("label_digest"),
        F.when(F.col("images").isNotNull(), F.size("images")).alias("image_size"),
        F.round(F.col("images")[0].cast("double"), 6).alias("first_value"),
        F.when(F.col("audios").isNotNull(), F.size("audios")).alias("audio_size"),
    )


def _layout_sql(preset: str, media_join: str = "", audio: str = "1", video: str = "1", image: str = "64") -> str:
    p = PRESETS[preset]
    sizes = {"image": image, "audio": audio, "video": video, "any": "1"}
    spans = " UNION ALL ".join(
        f"SELECT sample_id, {i + 1} AS part, '{kind}' AS kind, unnest(range({sizes[kind]})) AS src FROM m"
        for i, (kind, _) in enumerate(p.slots)
    )
    return f"""WITH {_sql_samples(p.max_len)}, m AS (SELECT sample_id, {_sql_spliced(p.media)} AS x
        {', e.vec_id AS vec_id, e.label AS label' if media_join else ''} FROM p {media_join}),
      parts AS (SELECT sample_id, 0 AS part, 'text' AS kind, unnest(range(least(len(x), {p.cut}))) AS src FROM m
        UNION ALL {spans}
        UNION ALL SELECT sample_id, 99, 'text', unnest(range(least(len(x), {p.cut}), len(x))) FROM m),
      l AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY part, src) - 1 AS pos FROM parts)
      SELECT sample_id, kind, count(*) AS n, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos,
        sum(pos * (src + 1))::BIGINT AS weight FROM l GROUP BY ALL"""


def _layout_summary(layout):
    return layout.groupBy("sample_id", "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.sum(F.col("pos").cast("bigint") * (F.col("src_pos") + 1)).alias("weight"),
    )


def _layout(name: str, preset: str):
    @query(name, _layout_sql(preset))
    def run(spark, sf_dir):
        return _layout_summary(sample_layout(prepare_samples(_samples(spark, sf_dir), preset), preset, "sample_id"))


_layout("slot_layout_image", "image")
_layout("slot_layout_audio", "audio")
_layout("slot_layout_multi", "video")
_layout("slot_layout_any", "any")


@query(
    "slot_layout_optional",
    _layout_sql(
        "video_optional",
        "LEFT JOIN embeddings e ON e.vec_id = p.sample_id",
        image="CASE WHEN vec_id IS NULL THEN 0 ELSE 64 END",
        audio="CASE WHEN label < 5 THEN 1 ELSE 0 END",
        video="CASE WHEN label >= 5 THEN 1 ELSE 0 END",
    ),
)
def slot_layout_optional(spark, sf_dir):
    vec, label = F.col("embedding"), F.col("label")
    media = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        vec.alias("image"),
        F.when(label < 5, vec).alias("audio"),
        F.when(label >= 5, vec).alias("video"),
    )
    df = _samples(spark, sf_dir).join(media, "sample_id", "left")
    features = {m: m for m in ("image", "audio", "video")}
    encoded = prepare_samples(df, "video_optional", features=features)
    return _layout_summary(sample_layout(encoded, "video_optional", "sample_id"))


@query(
    "aligned_mask",
    f"""WITH {_sql_samples(1984)}, m AS (SELECT sample_id, {_sql_spliced(("image",))} AS x FROM p),
      k AS (SELECT sample_id, list_transform(x, lambda v: (v <> 1)::INT) AS b FROM m),
      a AS (SELECT sample_id, list_concat(b[1:2], list_transform(range(64), lambda i: 1), b[3:]) AS mask FROM k)
    SELECT sample_id, len(mask)::INT AS n_mask, {sql_digest("mask")} AS digest FROM a""",
)
def aligned_mask(spark, sf_dir):
    df = prepare_samples(_samples(spark, sf_dir), "image")
    df = df.select("sample_id", sequences.aligned_mask("text_tokens", 2, 64).alias("mask"))
    return df.select("sample_id", F.size("mask").alias("n_mask"), I.checksum("mask").alias("digest"))


@query(
    "interleave_turns",
    f"""WITH seg AS (
        SELECT conv_id, turn * 2 AS o, {sql_bytes("text")} AS ids FROM conversations
        UNION ALL SELECT conv_id, turn * 2 + 1, [4, turn::INT + 12, 5] FROM conversations WHERE role = 'user'),
      whole AS (SELECT conv_id, list_concat([0], flatten(list(ids ORDER BY o)), [2]) AS ids FROM seg GROUP BY conv_id),
      parts AS (SELECT conv_id, unnest(range(0, len(ids), 512)) AS i, ids FROM whole)
    SELECT conv_id, i // 512 AS part_no, len(ids[i + 1:i + 512])::INT AS n_ids, {sql_digest("ids[i + 1:i + 512]")} AS digest
    FROM parts""",
)
def interleave_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    text = turns.select(
        "conv_id", (F.col("turn") * 2).alias("o"), F.lit("text").alias("kind"), I.byte_ids("text").alias("ids")
    )
    # An image slot after each user turn, its id made from the turn.
    media = turns.where(F.col("role") == "user").select(
        "conv_id",
        (F.col("turn") * 2 + 1).alias("o"),
        F.lit("image").alias("kind"),
        F.array((F.col("turn") + I.FIRST_PAYLOAD_ID).cast("int")).alias("ids"),
    )
    parts = sequences.interleave(text.unionByName(media), "conv_id", "o", "kind", "ids", 512)
    return parts.select(
        "conv_id", "part_no", F.size("input_ids").alias("n_ids"), I.checksum("input_ids").alias("digest")
    )
