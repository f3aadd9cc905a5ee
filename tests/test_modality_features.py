import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.functions import ids as I
from weftline.functions import vectors
from weftline.operators import features, modality, quality


@pytest.fixture
def catalogue(spark):
    rows = [(0, "a", ["text", "image"], 5), (1, "b", ["text"], 9), (2, "c", ["text", "text"], 9), (3, "d", [], 99)]
    return spark.createDataFrame(rows, "ord bigint, model_id string, tags array<string>, likes bigint")


def test_most_liked_and_first_match(spark, catalogue):
    wanted = modality.requested(catalogue, ["text", "image"])
    best = {r["modality"]: r["model_id"] for r in modality.choose_model(catalogue, wanted).collect()}
    assert best == {"text": "b", "image": "a"}
    first = modality.choose_model(catalogue, wanted, rank_by=None)
    assert {r["modality"]: r["model_id"] for r in first.collect()} == {"text": "a", "image": "a"}


def test_modality_without_entry(spark, catalogue):
    wanted = modality.requested(catalogue, ["audio"])
    with pytest.raises(PySparkException, match="no entry for modality audio"):
        modality.choose_model(catalogue, wanted).collect()
    assert modality.choose_model(catalogue, wanted, on_missing="null").first()["model_id"] is None


def test_catalogue_from_json(spark):
    df = spark.createDataFrame([(0, '{"modelId": "m", "tags": ["x"], "likes": 3}'), (1, "broken")], "o int, j string")
    rows = modality.parse_catalogue(df, "j", "o").orderBy("ord").collect()
    assert tuple(rows[0]) == (0, "m", ["x"], 3) and rows[1]["model_id"] is None


def test_any_list_keeps_order_and_length(spark):
    parts = [("text", "ab"), ("odd", "x"), ("text", "")]
    df = spark.createDataFrame([(parts,)], "parts array<struct<modality: string, data: string>>")
    row = modality.process_any(df, "parts", {"text": I.byte_ids}).first()
    assert row["outputs"] == [[109, 110], None, []]


def test_stack_chunks_and_shape(spark):
    rows = [(v, f, [float(f), float(v)]) for v in range(3) for f in range([7, 1, 40][v])]
    df = spark.createDataFrame(rows, "v int, f int, px array<double>").repartition(5)
    got = features.stack_frames(df, ["v"], "f", "px", chunk_frames=16).collect()
    assert {(r["v"], r["chunk_no"]): r["n_frames"] for r in got} == {
        (0, 0): 7, (1, 0): 1, (2, 0): 16, (2, 1): 16, (2, 2): 8,
    }
    frames = [p[0] for r in sorted(got, key=lambda r: (r["v"], r["chunk_no"])) if r["v"] == 2 for p in r["px"]]
    assert frames == [float(f) for f in range(40)]
    bad = df.union(spark.createDataFrame([(0, 99, [1.0])], df.schema))
    with pytest.raises(PySparkException, match="differ in size"):
        features.stack_frames(bad, ["v"], "f", "px").collect()


def test_pool_normalise_flatten(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 5.0]), (1, [7.0, 9.0])], "k int, v array<float>")
    got = {r["k"]: (r["n_frames"], r["v"]) for r in features.mean_pool(df, ["k"], "v").collect()}
    assert got == {0: (2, [2.0, 4.0]), 1: (1, [7.0, 9.0])}
    px = spark.createDataFrame([([255.0, 0.0], 1)], "p array<float>, c int")
    values = px.select(vectors.normalize_pixels("p", "c")).first()[0]
    assert values == pytest.approx([(1 - 0.394666) / 0.22145, -0.394666 / 0.22145])
    nested = spark.sql("SELECT array(array(array(1, 2), array(3)), array(array(4))) AS n")
    assert features.flatten_features(nested, "n", 2).first()["n"] == [1, 2, 3, 4]


def test_projection_forms_agree_and_keep_null(spark):
    weights = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, -2.0])], "out_dim int, w array<double>")
    df = spark.createDataFrame([(0, [2.0, 3.0]), (1, None), (2, [0.5, 0.0])], "k int, v array<double>")
    want = {0: [2.0, 5.0, -6.0], 2: [0.5, 0.5, 0.0]}
    got = {r["k"]: r["projected"] for r in features.project(df, "v", weights, ["k"]).collect()}
    assert got == {**want, 1: None}
    for size in (1, 16, 40):
        sliced = features.project(df, "v", weights, ["k"], slice_bytes=size)
        assert {r["k"]: r["projected"] for r in sliced.collect()} == {**want, 1: None}
        plan = sliced._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    doubled = df.union(df)
    assert features.project(doubled, "v", weights, ["k"], slice_bytes=1).count() == 6
    none = features.project(df, "v", weights.limit(0), ["k"])
    assert {r["k"]: r["projected"] for r in none.collect()} == {0: [], 1: None, 2: []}


def test_weights_do_not_depend_on_partitions(spark):
    ids = spark.range(200)
    a = features.init_weights(ids, "id", 8, pad_row=1).orderBy("id").collect()
    b = features.init_weights(ids.repartition(7), "id", 8, pad_row=1).orderBy("id").collect()
    assert a == b and a[1]["w"] == [0.0] * 8
    stats = features.init_weights(spark.range(5000), "id", 16).select(F.explode("w").alias("x"))
    row = stats.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert abs(row["m"]) < 0.005 and abs(row["s"] - 0.25) < 0.005


def test_vector_health(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.0, 0.0],), ([nan, 0.5],), ([inf, 0.5],), ([2.0],), ([],), (None,)]
    row = quality.vector_health(spark.createDataFrame(rows, "v array<float>"), "v").first()
    assert (row["n"], row["n_null"], row["n_nan"], row["n_inf"], row["n_out_of_range"]) == (6, 1, 1, 1, 1)
    assert (row["min_value"], row["max_value"]) == (0.0, 2.0)


def test_snapshot_and_shape(spark):
    a = spark.createDataFrame([("w", [1.0]), ("b", None), ("x", [3.0]), ("gone", [1.0])], "k string, v array<double>")
    b = spark.createDataFrame([("w", [2.0]), ("b", None), ("x", [3.0]), ("new", [1.0])], "k string, v array<double>")
    assert tuple(quality.snapshot_diff(a, b, "k", "v").first()) == (2, 1, 1, 1)
    assert tuple(quality.shape_check(a, {"v": 1}).first()) == (4, 1)


def test_require_fails_on_rows(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    with pytest.raises(PySparkException, match="x is missing"):
        quality.require(df, F.col("x").isNotNull(), "x is missing").collect()
    assert quality.require(df.where("x = 1"), F.col("x") == 1, "no").count() == 1


def test_zero_in_zero_out(spark):
    df = spark.createDataFrame([([0.0], [0.0]), ([0.0], [1.0]), ([2.0], [1.0])], "a array<double>, b array<double>")
    assert quality.zero_in_zero_out(df, "a", "b").count() == 1
