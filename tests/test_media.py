import io

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.sources import read_media, read_media_parts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("media")
    (path / "deep er").mkdir()
    (path / "a.bin").write_bytes(bytes(range(256)) * 10)
    (path / "deep er" / "b %20é.bin").write_bytes(b"x" * 1024)
    (path / "empty.bin").write_bytes(b"")
    (path / "c.txt").write_bytes(b"text")
    return path


def whole(parts):
    out = {}
    for r in parts.orderBy("path", "part_no").collect():
        name = r["path"].rsplit("/", 1)[1]
        assert r["start"] == len(out.get(name, b""))
        out[name] = out.get(name, b"") + bytes(r["content"])
    return out


@pytest.mark.parametrize("size", [1, 100, 1024, 1 << 20])
def test_parts_give_the_files(spark, folder, size):
    got = whole(read_media_parts(spark, str(folder), pattern="*.bin", part_bytes=size, parts_per_task=200))
    assert got == {"a.bin": bytes(range(256)) * 10, "b %20é.bin": b"x" * 1024}


def test_filters_leave_files_unopened(spark, folder):
    def refuse(path):
        raise OSError(f"opened {path}")

    none = read_media_parts(spark, str(folder), where=F.col("length") > 5000, open_file=refuse)
    assert none.count() == 0
    parts = read_media_parts(spark, str(folder), where=F.col("path").endswith(".txt"))
    assert whole(parts) == {"c.txt": b"text"}
    with pytest.raises(PySparkException, match="opened"):
        read_media_parts(spark, str(folder), pattern="a.bin", open_file=refuse).collect()


def test_a_long_file_is_read_by_several_tasks(spark, tmp_path):
    with open(tmp_path / "long.bin", "wb") as file:
        file.truncate(300 << 20)
        file.seek(299 << 20)
        file.write(b"end")
    parts = read_media_parts(spark, str(tmp_path))
    seen = parts.select(F.spark_partition_id().alias("task"), "part_no", F.length("content").alias("n")).collect()
    assert sum(r["n"] for r in seen) == 300 << 20 and len(seen) == 19
    assert len({r["task"] for r in seen}) == 3
    found = parts.where(F.locate("end", F.col("content").cast("string")) > 0).select("part_no").collect()
    assert [r[0] for r in found] == [299 // 16]


def test_long_content_is_refused_but_listed(spark, folder):
    files = read_media(spark, str(folder), max_bytes=1024)
    assert files.count() == 3
    assert {r["length"] for r in files.select("path", "length").collect()} == {2560, 1024, 4}
    with pytest.raises(PySparkException, match="more than 1024 bytes"):
        files.collect()
    short = files.where(F.col("length") <= 1024)
    assert sorted(len(r["content"]) for r in short.collect()) == [4, 1024]


def test_a_file_that_shrank_is_an_error(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 100)
    parts = read_media_parts(spark, str(tmp_path), part_bytes=40, open_file=lambda path: io.BytesIO(b"x" * 50))
    with pytest.raises(PySparkException, match="ends before its listed length"):
        parts.collect()


def test_empty_folder(spark, tmp_path):
    assert read_media_parts(spark, str(tmp_path)).count() == 0
