"""Every registered query over the smallest tables: with its SQL, or its columns and number of rows."""

import pytest
from oracle import compare, connect

import corpus_pipeline
from weftline.llm.queries import QUERIES
from weftline.llm.sql import SQL

SF = "/root/testdata/sf0.001"
#: Fixed columns of the queries, in the order of their contracts.
COLUMNS = {
    "op1_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_bpe_round_trip": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op6_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7_link_graph": "page_id host path rule verdict",
    "op8_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_html_extraction": "page_id url text n_chars",
    "op10_language_id": "doc_id held_out lang_pred score",
    "op11_ranked_search": "item_id rank doc_id score",
    "op12_source_mix": "doc_id size source_size target taken",
    "op13_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
    if name in SQL:
        assert compare(spark, con, SF, QUERIES[name], SQL[name]) is None
        return
    rows = spark.read.parquet(f"{SF}/{'pages' if 'page_id' in df.columns else 'documents'}.parquet").count()
    count = df.count()
    assert count >= rows if name.startswith("op8") else count == rows


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(COLUMNS["op8_best_fit_packing"].split()) <= set(out.columns) and out.count() > 0
