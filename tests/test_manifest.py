import glob
import os

import pytest
from pyspark.sql import functions as F

from weftline.sources import damaged_files, read_manifest, read_table, union_tables, write_table


@pytest.fixture
def ranks(spark):
    return spark.range(200).select(
        (F.col("id") % 4).cast("int").alias("rank"),
        F.expr("id div 4").alias("step"),
        F.array("id", F.col("id") * 2).alias("input_ids"),
        F.when(F.col("id") % 3 > 0, "t").alias("text"),
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_come_back_and_only_wanted_files_are_opened(spark, ranks, tmp_path):
    path = str(tmp_path / "t")
    write_table(ranks.repartition(7), path, "step", keys_per_file=10, by=["rank"])
    assert rows(read_table(spark, path)) == rows(ranks)
    assert read_manifest(spark, path).where("file IS NOT NULL").count() == 20
    late = read_table(spark, path, first=33)
    assert rows(late) == rows(ranks.where("step >= 33"))
    assert len(late.inputFiles()) == 8
    one = read_table(spark, path, first=12, stop=20, rank=2)
    assert rows(one) == rows(ranks.where("step BETWEEN 12 AND 19 AND rank = 2")) and len(one.inputFiles()) == 1
    assert read_table(spark, path, first=50).count() == 0
    with pytest.raises(ValueError, match="not apart for text"):
        read_table(spark, path, text="t")


def test_a_run_that_dies_leaves_no_table(spark, ranks, tmp_path):
    path = str(tmp_path / "t")
    bad = ranks.withColumn("text", F.when(F.col("step") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        write_table(bad, path, "step", 10)
    with pytest.raises(ValueError, match="no complete table"):
        read_table(spark, path)
    # Files of another run that died after some of them: never read.
    ranks.write.parquet(f"{path}/data-dead")
    write_table(ranks, path, "step", 10)
    assert rows(read_table(spark, path)) == rows(ranks)
    with pytest.raises(ValueError, match="already holds"):
        write_table(ranks, path, "step", 10)


def test_damage_is_found(spark, ranks, tmp_path):
    path, other = str(tmp_path / "t"), str(tmp_path / "u")
    for p in (path, other):
        write_table(ranks, p, "step", 10)
    assert damaged_files(spark, path).count() == 0
    files = sorted(glob.glob(f"{path}/data-*/*/*.parquet"))
    os.remove(files[0])
    changed = spark.read.parquet(files[1]).withColumn("text", F.lit("x")).coalesce(1)
    changed.write.parquet(str(tmp_path / "changed"))
    os.remove(os.path.join(os.path.dirname(files[1]), f".{os.path.basename(files[1])}.crc"))
    with open(glob.glob(str(tmp_path / "changed" / "*.parquet"))[0], "rb") as f, open(files[1], "wb") as g:
        g.write(f.read())
    assert damaged_files(spark, path).count() == 2
    with pytest.raises(ValueError, match="damaged"):
        union_tables(spark, [other, path], verify=True)


def test_union_checks_schemas(spark, ranks, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    write_table(ranks, a, "step")
    write_table(ranks, b, "step", 7)
    write_table(ranks.drop("text"), c, "step")
    assert rows(union_tables(spark, [a, b], verify=True)) == rows(ranks.union(ranks))
    with pytest.raises(ValueError, match="another schema"):
        union_tables(spark, [a, c])


def test_empty_table_and_null_keys(spark, ranks, tmp_path):
    path = str(tmp_path / "t")
    write_table(ranks.limit(0), path, "step")
    got = read_table(spark, path)
    assert got.count() == 0 and got.columns == ranks.columns and damaged_files(spark, path).count() == 0
    with pytest.raises(Exception, match="step is NULL"):
        write_table(ranks.withColumn("step", F.lit(None).cast("bigint")), str(tmp_path / "n"), "step")
