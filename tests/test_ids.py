import pytest
from pyspark.sql import functions as F

from weftline.functions import ids as I
from weftline.functions import paths, vectors


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return row.select(column).first()[0]


@pytest.mark.parametrize("text", ["", "a", "añ", "日本語", "😀 mixed\n\t", "\x00\x7f", "x" * 5000])
def test_byte_ids_are_the_utf8_bytes(spark, text):
    assert one(spark, I.byte_ids("t"), t=text) == [b + 12 for b in text.encode()]
    assert one(spark, I.byte_count("t"), t=text) == len(text.encode())


def test_byte_ids_of_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(I.byte_ids("t")).first()[0] is None


def test_every_text_has_at_least_the_end_mark(spark):
    assert one(spark, I.append_eos(I.byte_ids("t")), t="") == [2]
    assert one(spark, I.append_eos_text("t"), t="") == "<eos>"


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_splice(spark, k):
    marks = I.markers(I.MEDIA[:k])
    given = [[], [0], [0, 20], [0, 20, 21, 2]]
    df = spark.createDataFrame([(ids,) for ids in given], "x array<int>")
    got = df.select("x", I.splice_after_first("x", marks)).collect()
    assert all(spliced == ids[:1] + marks + ids[1:] for ids, spliced in got) and len(got) == 4


def test_pad_and_truncate(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "x array<int>")
    row = df.select(I.truncate("x", 2), I.pad_to("x", F.lit(5)), I.pad_to("x", F.lit(2))).first()
    assert list(row) == [[5, 6], [5, 6, 7, 1, 1], [5, 6, 7]]


def test_mask(spark):
    df = spark.createDataFrame([([0, 4, 5, 30, 2, 1, 1],)], "x array<int>")
    row = df.select(I.attention_mask("x"), I.attention_mask("x", prefix=0)).first()
    assert row[1] == [1, 1, 1, 1, 1, 0, 0]
    assert row[0] == [1] * 64 + row[1]


def test_special_ids(spark):
    df = spark.createDataFrame([("<s>",), ("</any>",), ("word",)], "t string")
    assert [r[0] for r in df.select(I.special_id("t")).collect()] == [0, 11, None]


@pytest.mark.parametrize(
    "path, modality",
    [
        ("a.JPG", "image"), (".jpg", None), ("x/.png", None), ("a.tar.gz", None), ("noext", None),
        ("a.b/c", None), ("..a.md", "text"), ("t.", None), ("dir.d/x.Mp4", "video"), ("s/1.csv", "csv"),
        ("r.pdf", "pdf"), ("q.ogg", "audio"),
    ],
)
def test_modality_from_path(spark, path, modality):
    assert one(spark, paths.modality_from_path("p"), p=path) == modality


def test_unknown_method_and_null_path(spark):
    df = spark.createDataFrame([("guess", None), ("file_extension", None)], "m string, p string")
    found = paths.detect_modality(F.col("m"), F.col("p"), F.lit(None).cast("binary"), F.lit("text"))
    assert [r[0] for r in df.select(found).collect()] == [None, None]


@pytest.mark.parametrize(
    "name, step",
    [("step_1000", 1000), ("out/step_20.pt", 20), ("epoch_3", None), ("step_5/x", None), ("a.b/step_7", 7)],
)
def test_checkpoint_step(spark, name, step):
    assert one(spark, paths.checkpoint_step("n"), n=name) == step


def test_vector_predicates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.0, 0.0],), ([nan, 1.0],), ([-inf],), ([],), (None,), ([0.5],)]
    df = spark.createDataFrame(rows, "v array<float>")
    got = [tuple(r) for r in df.select(vectors.has_bad("v"), vectors.all_zero("v")).collect()]
    assert got == [
        (False, True), (True, False), (True, False), (False, True), (None, None), (False, False),
    ]
