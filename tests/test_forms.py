"""Both forms of every size switch, and NULLs wherever rows could get lost."""

from pyspark.sql import functions as F

import pytest
from weftline.functions import ids as I
from weftline.operators import bpe, loader, modality, packing, run_metrics, vocabulary
from weftline.operators.ordering import with_offsets
from weftline.plans.corpus import byte_length, corpus_blocks, corpus_to_ranks, encoded_blocks

TEXTS = [(1, "a b a"), (1, "b c"), (1, "a b a"), (2, None), (3, ""), (4, "..."), (None, "c c"), (None, None), (5, "zz")]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_encode_forms_agree(spark, monkeypatch, rows):
    monkeypatch.setattr(vocabulary, "BROADCAST_ROWS", rows)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 5, 12), ("b", 4, 13), ("c", 3, 14)], "token string, count long, id int")
    got = vocabulary.encode(df, vocab).collect()
    want = [(1, [12, 13, 12]), (1, [13, 14]), (1, [12, 13, 12]), (2, None), (3, []), (4, []), (None, [14, 14]), (None, None), (5, [3])]
    assert sorted(map(repr, ((r.doc_id, r.input_ids) for r in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("rows", [200_000, 0])
def test_bpe_id_forms_agree(spark, monkeypatch, rows):
    monkeypatch.setattr(vocabulary, "BROADCAST_ROWS", rows)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    counts = spark.createDataFrame([("a", 5), ("bab", 4), ("b", 3), ("c", 3)], "token string, count long")
    merges = spark.createDataFrame([(0, "b", "a", 4), (1, "ba", "b", 4)], "rank int, left string, right string, count long")
    vocab = {r.symbol: r.id for r in bpe.symbol_vocab(counts, merges).collect()}
    assert vocab == {"b": 12, "a": 13, "c": 14, "ba": 15, "bab": 16}
    got = bpe.encode_bpe_ids(df, counts, merges).collect()
    want = [(1, [13, 12, 13]), (1, [12, 14]), (1, [13, 12, 13]), (2, None), (3, []), (4, []), (None, [14, 14]), (None, None), (5, [])]
    assert sorted(map(repr, ((r.doc_id, r.input_ids) for r in got))) == sorted(map(repr, want))
    more = spark.createDataFrame([(1, "bab c bab")], "doc_id long, text string")
    assert bpe.encode_bpe_ids(more, counts, merges).first().input_ids == [16, 14, 16]


def test_encoded_documents_are_packed_with_their_mask(spark):
    rows = [(0, [20, 21, 22]), (1, None), (2, []), (3, [23] * 9), (4, [24])]
    df = spark.createDataFrame(rows, "doc_id long, input_ids array<int>")
    ids = [x for _, own in rows for x in [*(own or []), I.EOS]]
    got = encoded_blocks(df, 4, None).orderBy("block_no").collect()
    assert [r.input_ids for r in got] == [ids[i : i + 4] for i in range(0, len(ids) // 4 * 4, 4)]
    assert all(r.attention_mask == [1] * 4 for r in got)


def expected_blocks(texts, size, keep_tail):
    ids = [x for t in texts for x in [*(b + 12 for b in (t or "").encode()), I.EOS]]
    blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
    return [b for b in blocks if len(b) == size or keep_tail]


@pytest.mark.parametrize("nulls", [[0], [3, 4, 5], [9], range(10)])
def test_null_text_is_one_end_mark(spark, nulls):
    texts = [None if i in nulls else f"text {i}" * (i + 1) for i in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = corpus_blocks(df, 8, None).orderBy("block_no").collect()
    assert [r.input_ids for r in blocks] == expected_blocks(texts, 8, False)
    report = packing.pack_report(df, byte_length(), 8, 10).where("is_total = 1").first()
    assert report.n_in == sum(len(t or "") + 1 for t in texts)


def test_ranges_of_rows_without_length(spark):
    df = spark.createDataFrame([(i, None if i < 6 else i) for i in range(12)], "k long, n long")
    for ranges in (1, 2, 4, 12):
        got = with_offsets(df, ["k"], F.col("n"), ranges=ranges).orderBy("k").collect()
        assert [r.start for r in got] == [0] * 7 + [6, 13, 21, 30, 40]


@pytest.mark.parametrize("even", [False, True])
def test_corpus_to_ranks_packs_once(spark, even):
    texts = [f"text {i} " * (i % 7 + 1) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = expected_blocks(texts, 16, False)
    batches = [blocks[i : i + 3] for i in range(0, len(blocks), 3)]
    total = -(-len(batches) // 4) * 4 if even else len(batches)
    out = corpus_to_ranks(df, world_size=4, batch_size=3, block_size=16, even=even)
    got = {(r.rank, r.local_step): r.input_ids for r in out.collect()}
    assert got == {(b % 4, b // 4): batches[b % len(batches)] for b in range(total)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The texts move once, by range; the branch of the crossing blocks uses the same shuffle.
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(_range" in line]
    assert sum("ReusedExchange" not in line for line in moved) == 1


def test_latency_of_a_null_group(spark):
    rows = [("a", 0, 2), ("a", 0, 4), (None, 0, 6), (None, 0, 8)]
    df = spark.createDataFrame(rows, "g string, s long, e long").select(
        "g", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e")
    )
    got = {r.g: (r.n_runs, r.mean_s, r.p50_s, r.p95_s) for r in run_metrics.latency(df, "s", "e", ["g"]).collect()}
    assert got["a"][:2] == (2, 3.0) and got[None][:2] == (2, 7.0)
    assert got["a"][2] == 3.0 and got[None][2] == 7.0 and got[None][3] is not None


def test_routed_tables_keep_all_rows(spark):
    df = spark.createDataFrame([(1, "text"), (2, "image"), (3, None), (4, "csv")], "n int, modality string")
    handlers = {"text": lambda d: d.select("modality", (F.col("n") * 2).alias("cost"))}
    got = modality.route_tables(df, handlers).collect()
    assert sorted(map(repr, ((r.modality, r.cost) for r in got))) == sorted(
        map(repr, [("text", 2), ("image", None), (None, None), ("csv", None)])
    )


def test_batches_of_a_dense_ordinal(spark):
    df = spark.createDataFrame([(i, [i]) for i in range(7)], "k long, v array<long>")
    a = loader.to_batches(df, ["k"], ["v"], 3).orderBy("batch_id").collect()
    b = loader.collate(df, F.col("k"), ["v"], 3).orderBy("batch_id").collect()
    assert a == b and [r.n_rows for r in a] == [3, 3, 1]
