"""Work that must follow the size of the tables: what a step computes, moves or holds at once."""

import math
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions.ids import EOS, byte_chars, ids_of_chars
from weftline.operators import bpe, features, packing, text_metrics, vocabulary
from weftline.operators.vocabulary import word_slices
from weftline.plans.catalog import QUERIES, stream_queries
from weftline.plans.corpus import coded_blocks, encoded_blocks

SMALL = "/root/testdata/sf0.001"


def test_weight_values_are_those_of_the_vectors(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "token string")
    vectors = features.init_weights(rows, "token", 5).select("token", F.posexplode("w").alias("dim", "x"))
    values = features.weight_values(rows, "token", 5)
    assert sorted(map(repr, values.collect())) == sorted(map(repr, vectors.collect()))


def test_weights_are_made_after_words_are_grouped(spark):
    plan = QUERIES["weight_moments"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # What stands below a line runs before it.
    before = plan[plan.index("Aggregate [token") :]
    assert "md5" in plan and "md5" not in before


def test_aligned_mask_has_the_length_of_its_layout(spark, tmp_path):
    rows = [(0, 0, "a" * 2031), (0, 1, "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    layout = QUERIES["slot_layout_image"](spark, str(tmp_path)).groupBy("sample_id").agg(F.max("last_pos").alias("last"))
    want = {r.sample_id: r["last"] + 1 for r in layout.collect()}
    got = {r.sample_id: r.n_mask for r in QUERIES["aligned_mask"](spark, str(tmp_path)).collect()}
    assert got[0] == got[1] == 2033 + 2 + 64
    assert got == want


def _model(spark):
    counts = spark.createDataFrame([("abab", 5), ("ab", 4), ("cä", 3), ("c", 2)], "token string, count long")
    return counts, bpe.train_bpe(counts, 3)


def test_bpe_ids_shuffle_no_words(spark):
    df = spark.createDataFrame([(1, "abab c, abab cä"), (2, None), (3, "")], "doc_id long, text string")
    coded = bpe.encode_bpe_ids(df, *_model(spark))
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    rows = {r.doc_id: r.input_ids for r in coded.collect()}
    assert len(rows[1]) == 4 and rows[1][0] == rows[1][2] and rows[2] is None and rows[3] == []


def test_blocks_of_coded_texts_move_no_mask(spark):
    rows = [(i, None if i % 7 == 3 else "abab c ab cä " * (i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = _model(spark)
    want = encoded_blocks(bpe.encode_bpe_ids(df, *model), 16, 10)
    blocks = coded_blocks(df, *bpe.id_coder(*model), 16, 10)
    shown = ("batch_id", "block_no", "input_ids", "attention_mask")
    assert sorted(map(tuple, blocks.select(*shown).collect())) == sorted(map(tuple, want.select(*shown).collect()))
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    # The mask is made from finished blocks and not moved with them.
    assert "attention_mask, attention_mask#" not in plan


def test_words_are_coded_in_slices():
    lists = [["abc", "d"], None, [], ["x" * 50], ["e"] * 4, ["f"] * 8]
    column = pa.array(lists, pa.list_(pa.string()))
    parts = [part.to_pylist() for part in word_slices(column, 10)]
    assert [row for part in parts for row in part] == lists
    assert all(len(part) == 1 or sum(len(w) for row in part for w in row or ()) <= 10 for part in parts)


def test_word_stats_shuffle_no_words(spark, tmp_path):
    rows = [(1, "a b a"), (2, "é cc"), (3, None), (4, "..."), (5, "x y"), (5, "y zz y"), (None, "q"), (None, "q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in vocabulary.word_stats(df).collect()}
    assert got == {1: (3, 2, 2, 6), 2: (2, 1, 2, 5), 5: (5, 2, 3, 11), None: (3, 1, 2, 4)}
    plan = vocabulary.word_stats(df.where("doc_id < 5"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_perplexity_moves_rare_words_only(spark, monkeypatch):
    rows = [(1, "a b a"), (1, "c"), (2, "a"), (3, None), (4, ". ,"), (None, "b rare"), (6, "long" * 100 + " a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ways = []
    for known in (200_000, 2, 0):
        monkeypatch.setattr(text_metrics, "KNOWN_ROWS", known)
        ways.append({r.doc_id: (r.n_words, round(r.perplexity, 9)) for r in text_metrics.unigram_perplexity(df).collect()})
    counts, size = {"a": 4, "b": 2, "c": 1, "rare": 1, "long" * 100: 1}, 9 + 5
    words = {1: "a b a c", 2: "a", None: "b rare", 6: "long" * 100 + " a"}
    want = {}
    for key, text in words.items():
        losses = [-math.log((counts[w] + 1) / size) for w in text.split()]
        want[key] = (len(losses), round(math.exp(sum(losses) / len(losses)), 9))
    assert ways == [want] * 3
    monkeypatch.setattr(text_metrics, "KNOWN_ROWS", 200_000)
    plan = text_metrics.unigram_perplexity(df)._jdf.queryExecution().optimizedPlan().toString()
    # Common words are counted in place: no row per document and word is grouped.
    assert "explode" not in plan


def test_char_ids_come_in_slices():
    texts = ["abĀ", None, "", "é" * 30, "c", "d\xff"]
    parts = list(packing._ids_by_slice(pa.array(texts, pa.string()), 5))
    got = [row for part in parts for row in part.to_pylist()]
    assert got == [None if t is None else [EOS if c == "Ā" else ord(c) + 12 for c in t] for t in texts]
    assert len(parts) > 2


def test_char_ids_are_the_built_in_ones(spark):
    df = spark.createDataFrame([("aé\n",), ("",), (None,), ("x" * 3000,)], "text string").withColumn("chars", byte_chars("text"))
    both = df.select(packing.char_ids("chars").alias("a"), ids_of_chars("chars").alias("b")).collect()
    assert len(both) == 4 and all(r.a == r.b for r in both)


def test_stream_files_follow_the_size_of_the_texts(spark, monkeypatch):
    shown = ("source", "lane", "n_blocks", "n_ids", "last_block", "n_tail", "sum_ids", "sum_squares")
    want = sorted(map(tuple, QUERIES["stream_pack"](spark, SMALL).select(*shown).collect()))
    written, inner = [], stream_queries.scratch_path

    def noted(spark, name):
        path = inner(spark, name)
        written.append(path)
        return path

    monkeypatch.setattr(stream_queries, "scratch_path", noted)
    monkeypatch.setattr(stream_queries, "FILE_BYTES", 50_000)
    got = sorted(map(tuple, QUERIES["stream_pack"](spark, SMALL).select(*shown).collect()))
    assert got == want
    arriving = next(p for p in written if "arriving" in p)
    n_bytes = spark.read.parquet(arriving).agg(F.sum(F.octet_length("chars"))).first()[0]
    n_files = len(list(Path(arriving).glob("*.parquet")))
    assert n_files > 4 and n_bytes / n_files < 2 * 50_000
