"""Routing by file name, content and catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import ids as I
from ...functions import paths
from ...operators import modality
from .registry import SQL_MODALITY, SQL_PATH, derived_path, query, sql_bytes, sql_digest, sql_words, table

# File signatures put in front of a document, and the modality each one means.
SIGNATURES = [
    ("89504E470D0A1A0A", "image"),
    ("FFD8FFE0", "image"),
    ("424D", "image"),
    ("524946460000000057415645", "audio"),
    ("494433", "audio"),
    ("4F676753", "audio"),
    ("000000186674797069736F6D", "video"),
    ("524946460000000041564920", "video"),
    ("255044462D", "pdf"),
    ("0000", None),
]


def _files(spark, sf_dir):
    n = len(SIGNATURES)
    head = F.element_at(
        F.array(*[F.lit(s) for s, _ in SIGNATURES]), (F.col("doc_id") % n + 1).cast("int")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        derived_path().alias("path"),
        F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"),
    )


_SQL_CONTENT = (
    "([" + ", ".join("NULL" if m is None else f"'{m}'" for _, m in SIGNATURES)
    + f"])[(doc_id % {len(SIGNATURES)})::INT + 1]"
)


@query(
    "modality_by_extension",
    f"""SELECT doc_id, path, {SQL_MODALITY} AS modality FROM (SELECT doc_id, {SQL_PATH} AS path FROM documents)""",
)
def modality_by_extension(spark, sf_dir):
    return (
        _files(spark, sf_dir)
        .select("doc_id", "path")
        .withColumn("modality", paths.modality_from_path("path"))
    )


@query(
    "modality_by_content",
    f"""SELECT doc_id, {_SQL_CONTENT} AS modality FROM documents""",
)
def modality_by_content(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", paths.modality_from_content("content").alias("modality"))


@query(
    "modality_dispatch",
    f"""WITH f AS (SELECT doc_id, lang, {SQL_PATH} AS path,
        (['file_extension', 'content_based', 'user_input', 'guess'])[(doc_id // 10 % 4)::INT + 1] AS method FROM documents)
    SELECT doc_id, method, CASE method WHEN 'file_extension' THEN {SQL_MODALITY}
      WHEN 'content_based' THEN {_SQL_CONTENT} WHEN 'user_input' THEN lang END AS modality FROM f""",
)
def modality_dispatch(spark, sf_dir):
    methods = F.array(*[F.lit(m) for m in ("file_extension", "content_based", "user_input", "guess")])
    method = F.element_at(methods, (F.expr("doc_id div 10") % 4 + 1).cast("int"))
    files = _files(spark, sf_dir).withColumn("method", method)
    found = paths.detect_modality(F.col("method"), F.col("path"), F.col("content"), F.col("lang"))
    return files.select("doc_id", "method", found.alias("modality"))


def _catalogue(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entry = F.to_json(
        F.struct(
            F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("modelId"),
            F.split("p_name", " ").alias("tags"),
            F.col("p_size").alias("likes"),
        )
    )
    return modality.parse_catalogue(part.select("p_partkey", entry.alias("j")), "j", "p_partkey")


def _top_sql(order: str) -> str:
    return f"""WITH c AS (SELECT p_partkey AS ord, p_brand || '-' || p_partkey AS model_id, p_size::BIGINT AS likes,
        unnest(list_distinct(string_split(p_name, ' '))) AS modality FROM part)
      SELECT modality, model_id, likes, ord FROM c
      QUALIFY row_number() OVER (PARTITION BY modality ORDER BY {order}) = 1"""


@query("catalogue_top1", _top_sql("likes DESC, ord"))
def catalogue_top1(spark, sf_dir):
    catalogue = _catalogue(spark, sf_dir)
    wanted = catalogue.select(F.explode("tags").alias("modality")).distinct()
    return modality.choose_model(catalogue, wanted)


@query("catalogue_first_match", _top_sql("ord"))
def catalogue_first_match(spark, sf_dir):
    catalogue = _catalogue(spark, sf_dir)
    wanted = catalogue.select(F.explode("tags").alias("modality")).distinct()
    return modality.choose_model(catalogue, wanted, rank_by=None)


_HANDLERS = {
    "text": I.byte_ids,
    "csv": lambda c: I.append_eos(I.byte_ids(F.lower(c))),
    "image": lambda c: F.transform(I.words(c), lambda w: F.length(w) + I.FIRST_PAYLOAD_ID),
}


def _sql_handled(modality_col: str, data: str) -> str:
    return f"""CASE {modality_col} WHEN 'text' THEN {sql_bytes(data)}
      WHEN 'csv' THEN list_append({sql_bytes(f"lower({data})")}, 2)
      WHEN 'image' THEN list_transform({sql_words(data)}, lambda w: length(w)::INT + 12) END"""


@query(
    "routed_rows",
    f"""WITH f AS (SELECT doc_id, text, {SQL_PATH} AS path FROM documents),
      m AS (SELECT doc_id, text, {SQL_MODALITY} AS modality FROM f),
      h AS (SELECT doc_id, modality, {_sql_handled("modality", "text")} AS ids FROM m)
    SELECT doc_id, modality, len(ids)::INT AS n_ids, {sql_digest("ids")} AS digest FROM h""",
)
def routed_rows(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(
        "doc_id", "text", derived_path().alias("path")
    )
    df = df.withColumn("modality", paths.modality_from_path("path"))
    routed = modality.route(df, _HANDLERS, data="text", out="ids")
    return routed.select(
        "doc_id",
        "modality",
        F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_ids"),
        I.checksum("ids").alias("digest"),
    )


@query(
    "routed_union",
    f"""WITH f AS (SELECT doc_id, n_chars, {SQL_PATH} AS path FROM documents),
      m AS (SELECT doc_id, n_chars, {SQL_MODALITY} AS modality FROM f)
    SELECT modality, count(*) AS n, sum(CASE modality WHEN 'audio' THEN n_chars * 2 WHEN 'video' THEN n_chars * 3 WHEN 'text' THEN n_chars END)::BIGINT
      AS cost FROM m GROUP BY modality""",
)
def routed_union(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars", derived_path().alias("path"))
    df = df.withColumn("modality", paths.modality_from_path("path"))
    routed = modality.route_tables(
        df,
        {
            "text": lambda d: d.select("modality", F.col("n_chars").alias("cost")),
            "audio": lambda d: d.select("modality", (F.col("n_chars") * 2).alias("cost")),
            "video": lambda d: d.select("modality", (F.col("n_chars") * 3).alias("cost")),
        },
    )
    return routed.groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query(
    "any_modality_stack",
    f"""WITH p AS (SELECT conv_id * 1000 + turn AS sample_id, text,
        [['text', text], ['image', text], ['csv', text || ',1'], ['smell', text]] AS parts FROM conversations),
      e AS (SELECT sample_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM p),
      h AS (SELECT sample_id, pos, {_sql_handled("part[1]", "part[2]")} AS ids FROM e)
    SELECT sample_id, pos::INT AS pos, len(ids)::INT AS n_ids, {sql_digest("ids")} AS digest FROM h""",
)
def any_modality_stack(spark, sf_dir):
    def part(name, data):
        return F.struct(F.lit(name).alias("modality"), data.alias("data"))

    text = F.col("text")
    df = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"),
        F.array(
            part("text", text),
            part("image", text),
            part("csv", F.concat(text, F.lit(",1"))),
            part("smell", text),
        ).alias("parts"),
    )
    out = modality.process_any(df, "parts", _HANDLERS)
    return out.select("sample_id", F.posexplode("outputs").alias("pos", "ids")).select(
        "sample_id",
        "pos",
        F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_ids"),
        I.checksum("ids").alias("digest"),
    )
