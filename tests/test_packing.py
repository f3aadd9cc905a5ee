import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.functions import ids as I
from weftline.operators import packing
from weftline.plans.corpus import corpus_blocks


def docs(spark, lengths, seed=3):
    rows, at = [], 0
    for i, n in enumerate(lengths):
        rows.append((i, list(range(at, at + n)), [i] * n))
        at += n
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "doc_id bigint, ids array<int>, src array<int>").repartition(3)


def packed(rows, block, batch_rows, keep_short=True):
    out = {}
    for b in range(0, len(rows), batch_rows):
        part = rows[b : b + batch_rows]
        for c, name in ((1, "ids"), (2, "src")):
            flat = [x for r in part for x in r[c]]
            total = len(flat) // block * block if len(flat) >= block else (len(flat) if keep_short else 0)
            for k in range(0, total, block):
                out.setdefault((b // batch_rows, k // block), {})[name] = flat[k : k + block]
    return out


LENGTHS = {
    "below": [1, 2, 1],
    "equal": [3, 5, 2],
    "above": [4, 25, 1, 9],
    "spans three blocks": [7, 28, 3, 1, 1],
    "single ids": [1] * 37,
    "with empty": [0, 4, 0, 0, 13, 0],
    "long": [random.Random(5).randint(0, 60) for _ in range(120)],
}


@pytest.mark.parametrize("name", LENGTHS)
@pytest.mark.parametrize("batch_rows, ranges", [(4, 6), (1000, 2)])
def test_pack_batches_equals_plain_lists(spark, name, batch_rows, ranges):
    rows, df = docs(spark, LENGTHS[name])
    got = packing.pack_batches(df, ["ids", "src"], 10, batch_rows, ranges=ranges).collect()
    want = packed(rows, 10, batch_rows)
    assert len(got) == len(want)
    for r in got:
        assert want[r["batch_id"], r["block_no"]] == {"ids": r["ids"], "src": r["src"]}


@pytest.mark.parametrize("keep_tail", [False, True])
@pytest.mark.parametrize("ranges", [1, 11])
def test_pack_global(spark, keep_tail, ranges):
    rows, df = docs(spark, LENGTHS["long"])
    flat = [x for r in rows for x in r[1]]
    got = packing.pack_global(df, ["ids"], 16, keep_tail=keep_tail, ranges=ranges).collect()
    want = [flat[i : i + 16] for i in range(0, len(flat), 16)]
    if len(want[-1]) < 16 and not keep_tail:
        want = want[:-1]
    assert [r["ids"] for r in sorted(got, key=lambda r: r["block_no"])] == want


@pytest.mark.parametrize("ranges", [1, 13])
def test_pack_by_key_with_a_hot_key(spark, ranges):
    rows = [("hot", i, [i] * (i % 5)) for i in range(100)] + [(f"k{i % 9}", i, [i, i]) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, i int, ids array<int>").repartition(4)
    got = packing.pack_by_key(df, ["key"], ["ids"], 8, ["i"], ranges=ranges).collect()
    for key in {r[0] for r in rows}:
        flat = [x for k, _, ids in rows if k == key for x in ids]
        mine = sorted((r for r in got if r["key"] == key), key=lambda r: r["block_no"])
        assert [r["ids"] for r in mine] == [flat[i : i + 8] for i in range(0, len(flat), 8)]


@pytest.mark.parametrize("batch_rows", [1, 5, None])
def test_text_blocks_equal_array_blocks(spark, batch_rows):
    texts = ["", "añ", "x" * 95, "日本語" * 9, "é", "line\nline\r\n" * 5, "", "😀" * 7, "\x00\u0100"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = [(i, [b + 12 for b in t.encode()] + [2]) for i, t in enumerate(texts)]
    rows = [(i, ids, [1] * len(ids)) for i, ids in rows]
    got = corpus_blocks(df, 16, batch_rows).collect()
    if batch_rows is None:
        flat = [x for r in rows for x in r[1]]
        assert {r["block_no"]: r["input_ids"] for r in got} == {
            i: flat[i * 16 : i * 16 + 16] for i in range(len(flat) // 16)
        }
        return
    want = packed(rows, 16, batch_rows)
    assert {(r["batch_id"], r["block_no"]): {"ids": r["input_ids"], "src": r["attention_mask"]} for r in got} == want


def test_columns_of_different_length_are_an_error(spark):
    df = spark.createDataFrame([(0, [1, 2], [1]), (1, [3], [1])], "doc_id bigint, a array<int>, b array<int>")
    with pytest.raises(PySparkException, match="announced length"):
        packing.pack_batches(df, ["a", "b"], 2).collect()


def test_report_adds_up(spark):
    _, df = docs(spark, LENGTHS["long"])
    report = packing.pack_report(df, F.size("ids"), 10, 7).collect()
    total = next(r for r in report if r["is_total"])
    assert all(r["n_in"] == r["n_kept"] + r["n_dropped"] for r in report)
    assert total["n_in"] == sum(LENGTHS["long"])
    blocks = packing.pack_batches(df, ["ids"], 10, 7)
    sizes = [len(r["ids"]) for r in blocks.collect()]
    assert total["n_kept"] == sum(sizes)
    assert (total["full_blocks"], total["short_blocks"]) == (sizes.count(10), len(sizes) - sizes.count(10))


def test_only_crossing_blocks_are_shuffled(spark):
    _, df = docs(spark, LENGTHS["long"])
    df = df.withColumn("text", F.lit("abc"))
    blocks = packing.pack_batches(
        df.select("doc_id", "text"), ["ids"], 10, 7, length=I.byte_count("text"), build={"ids": I.byte_ids("text")}
    )
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    # Two exchanges by range (one per branch, reused when run) and one by block.
    assert plan.count("Exchange hashpartitioning(_range") == 2
    assert plan.count("Exchange hashpartitioning(batch_id") == 1


@pytest.mark.parametrize("batch_rows", [7, None])
def test_both_branches_read_one_shuffle(spark, batch_rows):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), F.col("id").cast("int")).alias("text"))
    blocks = corpus_blocks(df, 64, batch_rows)
    blocks.collect()
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    # The plans of subqueries stand in between; no initial plan reuses an exchange.
    assert plan.count("ReusedExchange") == 1
