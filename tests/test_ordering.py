import datetime
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import ordering
from weftline.operators.ordering import with_offsets, with_ordinal


def shuffled(rows, seed=1):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return rows


KEYS = {
    "bigint": [i * i - 500 for i in range(60)],
    "string": [f"k{i:03d}é" for i in range(60)],
    "double": [i / 7 - 3 for i in range(60)],
    "timestamp": [datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=i) for i in range(60)],
    "date": [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(60)],
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("ranges", [7, 60])
def test_ordinal_of_each_key_type(spark, kind, ranges):
    keys = KEYS[kind]
    df = spark.createDataFrame(shuffled((k, i) for i, k in enumerate(keys)), f"k {kind}, i int")
    rows = with_ordinal(df.repartition(5), ["k"], ranges=ranges).select("i", "ord").collect()
    assert len(rows) == len(keys) and all(r["i"] == r["ord"] for r in rows)


def test_nulls_come_first_and_two_columns(spark):
    rows = [(None, 1), (None, 2), ("a", None), ("a", 1), ("a", 5), ("b", 0)]
    df = spark.createDataFrame(shuffled(rows), "a string, b int")
    for ranges in (1, 6):
        got = with_ordinal(df, ["a", "b"], ranges=ranges).collect()
        assert sorted(got, key=lambda r: r["ord"]) == [(a, b, i) for i, (a, b) in enumerate(rows)]


def test_empty(spark):
    df = spark.createDataFrame([], "k bigint")
    assert with_ordinal(df, ["k"]).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_same_result_for_any_partitioning(spark, partitions):
    rows = [(i, (i * 7) % 13) for i in range(200)]
    df = spark.createDataFrame(shuffled(rows, partitions), "k bigint, n int").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r["k"]: (r["ord"], r["start"]) for r in with_offsets(df, ["k"], F.col("n"), ranges=9).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    start = 0
    for k, n in rows:
        assert got[k] == (k, start)
        start += n


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_groups_that_cross_ranges(spark, ranges):
    # One key holds most rows and fills several ranges.
    rows = [("a", i) for i in range(3)] + [("b", i) for i in range(90)] + [("c", i) for i in range(7)]
    df = spark.createDataFrame(shuffled(rows), "g string, i int")
    got = with_offsets(
        df, ["g", "i"], F.col("i") % 4, {"key": F.col("g")}, ranges=ranges
    ).collect()
    want, rel = {}, {}
    for g, i in rows:
        want[g, i] = rel.get(g, 0)
        rel[g] = want[g, i] + i % 4
    assert {(r["g"], r["i"]): r["rel"] for r in got} == want


def test_no_single_partition_over_rows(spark):
    df = spark.range(1000).repartition(8)
    plan = with_ordinal(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(_range" in plan


def test_long_common_prefixes_fall_into_all_ranges(spark):
    df = spark.createDataFrame(shuffled((("p" * 300 + f"{i:05d}", i) for i in range(4000))), "k string, i int")
    rows = with_offsets(df.repartition(7), ["k"], ranges=16).select("i", "ord", "_range").collect()
    assert all(r["i"] == r["ord"] for r in rows)
    per_range = [sum(r["_range"] == n for r in rows) for n in range(16)]
    assert min(per_range) > 0 and max(per_range) <= 2 * 4000 / 16


def test_ranges_are_chosen_by_lengths(spark):
    # The first keys hold nearly all ids.
    lengths = [100_000 if i < 40 else 1 for i in range(4000)]
    df = spark.createDataFrame(shuffled(enumerate(lengths)), "k int, n int")
    rows = with_offsets(df, ["k"], F.col("n"), ranges=16).select("n", "_range").collect()
    share = (sum(lengths) + 4000) / 16
    for n in {r["_range"] for r in rows}:
        assert sum(r["n"] for r in rows if r["_range"] == n) <= share + 100_000


def test_few_bytes_for_bounds_give_fewer_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BOUND_BYTES", 3 * 330)
    df = spark.createDataFrame([("p" * 300 + f"{i:05d}", i) for i in range(200)], "k string, i int")
    rows = with_offsets(df, ["k"], ranges=16).collect()
    assert all(r["i"] == r["ord"] for r in rows) and len({r["_range"] for r in rows}) <= 3


def test_a_tie_is_an_error(spark):
    df = spark.createDataFrame([(i % 50, 1) for i in range(51)], "k int, n int")
    with pytest.raises(Exception, match="two rows with the same k"):
        with_ordinal(df, ["k"], ranges=4).collect()
    for key in (None, float("nan")):
        with pytest.raises(Exception, match="two rows with the same k"):
            with_ordinal(spark.createDataFrame([(key,), (key,)], "k double"), ["k"]).collect()
    ords = [r["ord"] for r in with_ordinal(df, ["k"], ranges=4, ties=True).collect()]
    assert sorted(ords) == list(range(51))


def test_bounds_are_not_in_the_plan(spark):
    df = spark.createDataFrame([(f"key-{i:04d}",) for i in range(500)], "k string").repartition(3)
    plan = with_ordinal(df, ["k"], ranges=50)._jdf.queryExecution().toString()
    assert "key-0" not in plan
