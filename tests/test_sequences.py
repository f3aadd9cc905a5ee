import pytest
from pyspark.sql import functions as F

from weftline.functions import ids as I
from weftline.operators import sequences
from weftline.plans.presets import PRESETS
from weftline.plans.samples import prepare_samples, sample_layout, text_ids


@pytest.fixture
def samples(spark):
    rows = [(0, "hello", 0), (1, "", 0), (2, "<image>", 1), (3, "x" * 3000, 2), (4, "é", 2)]
    return spark.createDataFrame(rows, "sample_id bigint, target_text string, batch_id bigint")


@pytest.mark.parametrize("preset", ["image", "audio_optional", "any"])
def test_encoded_sample_invariants(samples, preset):
    p = PRESETS[preset]
    k = 2 * len(p.media)
    rows = prepare_samples(samples, preset).collect()
    assert len(rows) == 5
    longest = {}
    for r in rows:
        longest[r["batch_id"]] = max(longest.get(r["batch_id"], 0), len(r["labels"]))
    for r in rows:
        tokens, labels, mask = r["text_tokens"], r["labels"], r["attention_mask"]
        assert len(labels) == longest[r["batch_id"]] <= p.max_len
        assert len(tokens) == len(labels) + k and len(mask) == p.prefix + len(tokens)
        assert tokens[:1] + tokens[1 + k :] == labels
        assert tokens[1 : 1 + k] == I.markers(p.media)
        assert mask == [1] * p.prefix + [int(t != I.PAD) for t in tokens]


def test_text_longer_than_the_cap(samples):
    row = text_ids(samples, "target_text", 1984).where("sample_id = 3").first()
    assert len(row["input_ids"]) == 1984 and row["input_ids"][0] == I.BOS


def test_budget_counts_markers(spark):
    df = spark.createDataFrame([(0, [5] * 1982), (1, [5] * 1984)], "i int, input_ids array<int>")
    rows = sequences.length_budget(df).orderBy("i").collect()
    # 1984 ids, two markers and 64 slots do not fit 2048 positions.
    assert [(r["total_len"], r["fits"]) for r in rows] == [(2048, True), (2050, False)]


def test_layout(samples):
    encoded = prepare_samples(samples, "video")
    rows = sample_layout(encoded, "video", "sample_id").where("sample_id = 0").orderBy("pos").collect()
    kinds = [r["kind"] for r in rows]
    n = len(encoded.where("sample_id = 0").first()["text_tokens"])
    assert kinds == ["text"] * 6 + ["image"] * 64 + ["audio", "video"] + ["text"] * (n - 6)
    assert [r["src_pos"] for r in rows if r["kind"] == "text"] == list(range(n))
    assert [r["pos"] for r in rows] == list(range(n + 66))


def test_layout_shorter_than_the_cut(spark):
    df = spark.createDataFrame([(0, [0]), (1, [])], "k int, x array<int>")
    rows = sequences.slot_layout(df, "x", 3, [("image", 2, None), ("audio", 1, F.col("k") == 1)], "k").collect()
    kinds = {k: [r["kind"] for r in sorted(rows, key=lambda r: r["pos"]) if r["k"] == k] for k in (0, 1)}
    assert kinds == {0: ["text", "image", "image"], 1: ["image", "image", "audio"]}


def test_disabled_modality_is_folded_away(spark):
    df = spark.createDataFrame([(0, [1.0])], "k int, audio array<double>")
    out = df.select("k", F.when(sequences.has_modality("audio", ["image"]), F.col("audio")).alias("audios"))
    assert out.first()["audios"] is None
    assert "audio#" not in out._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].replace("audios", "")


def test_interleave_wraps_media_and_continues(spark):
    rows = [(0, 0, "text", [20, 21]), (0, 1, "image", [30]), (0, 2, "video", []), (0, 3, "text", [22]), (1, 5, "audio", [40])]
    df = spark.createDataFrame(rows, "k int, o int, kind string, ids array<int>").repartition(3)
    whole = {0: [0, 20, 21, 4, 30, 5, 8, 9, 22, 2], 1: [0, 6, 40, 7, 2]}
    for size in (100, 4):
        got = {}
        for r in sequences.interleave(df, "k", "o", "kind", "ids", size).orderBy("k", "part_no").collect():
            assert len(r["input_ids"]) <= size
            got.setdefault(r["k"], []).extend(r["input_ids"])
        assert got == whole
