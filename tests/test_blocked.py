import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.operators import features
from weftline.operators.blocked import project_blocked


def matrix(spark, rows, cols, seed):
    values = np.random.default_rng(seed).normal(size=(rows, cols))
    return values, spark.createDataFrame(
        [(i * 3, values[i].tolist()) for i in np.random.default_rng(seed).permutation(rows).tolist()], "out_dim int, w array<double>"
    )


@pytest.mark.parametrize("rows,cols,chunk,per_task", [(1, 1, 1, 30), (2, 3, 200, 8), (3, 5, 1 << 20, 64), (100, 100, 500, 4)])
def test_blocks_of_any_shape_agree(spark, rows, cols, chunk, per_task):
    w, weights = matrix(spark, 7, 11, 1)
    x = np.random.default_rng(2).normal(size=(60, 11))
    given = [(i % 50, str(i), None if i % 7 == 3 else x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(given, "k int, name string, v array<double>").repartition(3)
    got = project_blocked(df, "v", weights, ["k", "name"], "y", rows, cols, chunk, per_task)
    assert got.columns == ["k", "name", "y"]
    found = {r["name"]: (r["k"], r["y"]) for r in got.collect()}
    assert len(found) == 60
    for k, name, v in given:
        assert found[name][0] == k
        if v is None:
            assert found[name][1] is None
        else:
            assert found[name][1] == pytest.approx((w @ x[int(name)]).tolist())


def test_wide_matrix_gives_the_rows_of_slices(spark):
    weights = features.init_weights(spark.range(2048).select(F.col("id").alias("out_dim")), "out_dim", 1024)
    vectors = features.init_weights(spark.range(40), "id", 1024, seed=7).withColumnRenamed("w", "v")
    got = project_blocked(vectors, "v", weights, ["id"], block_rows=512, block_cols=384)
    want = {r["id"]: r["projected"] for r in features.project(vectors, "v", weights, ["id"]).collect()}
    found = {r["id"]: r["projected"] for r in got.collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in want)
    # Blocks and chunks move as bytes; nothing is broadcast.
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_odd_tables(spark):
    _, weights = matrix(spark, 3, 2, 3)
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "k int, v array<float>")
    assert project_blocked(df.limit(0), "v", weights, ["k"]).count() == 0
    none = project_blocked(df, "v", weights.limit(0), ["k"]).collect()
    assert {r["k"]: r["projected"] for r in none} == {0: [], 1: None}
    only_null = project_blocked(df.where("v IS NULL"), "v", weights, ["k"]).collect()
    assert [tuple(r) for r in only_null] == [(1, None)]
    assert project_blocked(df.union(df), "v", weights, ["k"], block_rows=1, block_cols=1).count() == 4
    with pytest.raises(PySparkException, match="does not have the 2 values"):
        project_blocked(spark.createDataFrame([(0, [1.0])], df.schema), "v", weights, ["k"]).collect()
    with pytest.raises(ValueError, match="between 1 and 2"):
        project_blocked(df, "v", weights.union(spark.createDataFrame([(99, [1.0])], weights.schema)), ["k"])
