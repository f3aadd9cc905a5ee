import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.operators import loader
from weftline.sources import append_run_log, assemble, read_media, read_run_log
from weftline.sources import split_slice, union_shards, write_shards


@pytest.fixture
def rows(spark):
    return spark.range(23).select(F.col("id").alias("k"), F.array("id", "id").alias("v")).repartition(4)


def test_batches(rows):
    got = loader.to_batches(rows, ["k"], ["v"], 5).orderBy("batch_id").collect()
    assert [r["n_rows"] for r in got] == [5, 5, 5, 5, 3]
    assert [v[0] for r in got for v in r["v"]] == list(range(23))


def test_ragged_batch_is_an_error(spark):
    df = spark.createDataFrame([(0, [1]), (1, [1, 2])], "k int, v array<int>")
    with pytest.raises(PySparkException, match="differ in length"):
        loader.to_batches(df, ["k"], ["v"], 2).collect()
    assert loader.to_batches(df, ["k"], ["v"], 2, same_size=False).count() == 1


@pytest.mark.parametrize("world, n", [(4, 23), (16, 5), (5, 5), (1, 3)])
@pytest.mark.parametrize("even", [False, True])
def test_ranks_partition_the_batches(spark, world, n, even):
    df = spark.range(n).select(F.col("id").alias("batch_id"), F.col("id").alias("payload"))
    got = loader.shard_batches(df, world, even).collect()
    places = {(r["rank"], r["local_step"]) for r in got}
    assert len(places) == len(got)
    if even:
        steps = -(-n // world)
        assert places == {(k, s) for k in range(world) for s in range(steps)}
        assert all(r["payload"] == (r["local_step"] * world + r["rank"]) % n for r in got)
    else:
        assert sorted(r["payload"] for r in got) == list(range(n))


def test_step_plan(spark):
    row = loader.step_plan(spark.range(1003), batch=2, world=8, accum=4).first()
    assert row.asDict() == {
        "n_batches": 1003, "max_steps": 251, "batches_per_rank": 126, "max_steps_per_rank": 32,
        "warmup_steps": 2, "total_batch": 64,
    }
    assert loader.step_plan(spark.range(99)).first()["warmup_steps"] == 0


def test_cadence(spark):
    df = spark.range(1001).withColumnRenamed("id", "step")
    assert [r[0] for r in loader.at_cadence(df, 250, 900).orderBy("step").collect()] == [0, 250, 500, 750]
    assert loader.at_cadence(df, 500, include_zero=False).count() == 2


def test_resume(spark):
    df = spark.createDataFrame([("step_9",), ("step_1000",), ("note",)], "name string")
    row = loader.latest_checkpoint(df, accum=3).first()
    assert tuple(row) == ("step_1000", 1000, 3000)


def test_slices(rows):
    def keys(df):
        return sorted(r["k"] for r in df.collect())

    assert keys(split_slice(rows, ["k"], None, 10)) == list(range(10))
    assert keys(split_slice(rows, ["k"], 5, 9)) == [5, 6, 7, 8]
    assert keys(split_slice(rows, ["k"], 20)) == [20, 21, 22]
    parts = [split_slice(rows, ["k"], a, a + 20, "percent") for a in range(0, 100, 20)]
    assert keys(union_shards(parts)) == list(range(23))


def test_shards_and_union_keep_duplicates(spark, rows, tmp_path):
    path = str(tmp_path / "shards")
    write_shards(rows, path, ["k"], 5)
    sizes = {r["shard"]: r["count"] for r in spark.read.parquet(path).groupBy("shard").count().collect()}
    assert sum(sizes.values()) == 23 and len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1
    assert union_shards([rows, rows]).count() == 46
    scan = spark.read.parquet(path).where("shard = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in scan


def test_assemble_keeps_texts_and_rejects_double_rows(spark):
    text = spark.createDataFrame([(0, "a"), (1, "b")], "sample_id int, t string")
    image = spark.createDataFrame([(1, [1.0])], "sample_id int, px array<double>")
    got = {r["sample_id"]: r["image"] for r in assemble(text, images=image).collect()}
    assert got[0] is None and got[1]["px"] == [1.0]
    with pytest.raises(PySparkException, match="more than one image"):
        assemble(text, images=image.union(image)).collect()


def test_media_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    (tmp_path / "deep" / "b.wav").write_bytes(b"RIFF\x00\x00\x00\x00WAVE")
    files = read_media(spark, str(tmp_path))
    from weftline.functions.paths import modality_from_content, modality_from_path

    got = files.select(modality_from_path("path"), modality_from_content("content")).collect()
    assert sorted(tuple(r) for r in got) == [("audio", "audio"), ("image", "image")]
    listing = files.select("path", "length")
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.sql("SELECT 1L AS run_id, 0L AS step, timestamp'2024-01-01' AS ts, 'loss' AS metric, 2.5D AS value")
    append_run_log(df, path)
    append_run_log(df.withColumn("step", F.lit(1).cast("bigint")), path)
    assert read_run_log(spark, path).count() == 2


def test_scan_is_pruned_and_filtered(spark):
    from weftline.sources import read_corpus

    df = read_corpus(spark, "/root/testdata/sf0.001/documents.parquet", ["doc_id", "n_chars"]).where("n_chars > 1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan and "GreaterThan(n_chars,1000)" in plan
