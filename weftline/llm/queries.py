"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, exact, html, langid, linkgraph, mixing, neardup, packing, pii, quality, search, suffix
from .sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_dedup(table(spark, sf_dir, "documents"), neardup.Params(shingle=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir, "documents"))


@query("op4_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op5_exact_dedup")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows (by a hash of the id) stand for the stored snapshot, the rest is the new batch."""
    stored = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return exact.exact_dedup(table(spark, sf_dir, "documents"), stored)


@query("op6_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


#: Fixed values of the query: verdict, host, beginning of the path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query("op7_link_graph")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"), RULES)


@query("op8_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), langid.remainder() != 1)
    held_out = F.coalesce(langid.remainder() == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits", "margin", "rejected")


@query("op11_ranked_search")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query("op12_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix as large as the table; a quarter and a half of it are nested in it (``quarter``, ``half``)."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), budgets=(0.25, 0.5, 1.0))
    quarter, half, whole = (F.element_at("mixes", k) for k in (1, 2, 3))
    return mixed.select(
        "doc_id", "size", "source_size", whole["target"].alias("target"), whole["taken"].alias("taken"),
        quarter["taken"].alias("quarter"), half["taken"].alias("half"),
    )


@query("op13_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), first, second)


__all__ = ["QUERIES", "SQL"]
