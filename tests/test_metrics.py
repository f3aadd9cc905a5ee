import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import quantiles, run_metrics, text_metrics


def grams(words, n):
    return collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def bleu(pairs):
    matched, total, h_len, r_len = [0] * 4, [0] * 4, 0, 0
    for hyp, refs in pairs:
        h, rs = hyp.split(), [r.split() for r in refs]
        h_len += len(h)
        r_len += min((abs(len(r) - len(h)), len(r)) for r in rs)[1]
        for n in range(1, 5):
            mine = grams(h, n)
            most = collections.Counter()
            for r in rs:
                most |= grams(r, n)
            matched[n - 1] += sum((mine & most).values())
            total[n - 1] += sum(mine.values())
    if min(matched) == 0:
        return 0.0
    penalty = 1.0 if h_len >= r_len else math.exp(1 - r_len / h_len)
    return penalty * math.exp(sum(math.log(m / t) for m, t in zip(matched, total)) / 4)


@pytest.mark.parametrize(
    "pairs",
    [
        [("the cat sat on the mat today", ["the cat sat on a mat today", "a cat sat on the mat"])],
        [("a b c", ["a b c d"])],
        [("the the the the the", ["the cat the dog the"]), ("a b c d e f", ["a b c d e f"])],
        [("a b c d e f g h i", ["a b c d e"]), ("", ["x"])],
    ],
)
def test_bleu(spark, pairs):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "id int, hyp string, refs array<string>")
    assert text_metrics.corpus_bleu(df).first()["bleu"] == pytest.approx(bleu(pairs))


@pytest.mark.parametrize("seed", range(8))
def test_overlaps_count_every_pair_by_itself(seed):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 3, 30, 300])))
    pairs = [(text(), [text() for _ in range(rng.randint(1, 4))]) for _ in range(rng.choice([0, 1, 25]))]
    ns = [[1, 2, 3, 4], [2], [1, 3]][seed % 3]
    hyps, refs = (pa.array(c, pa.string()) for c in ([h for h, _ in pairs], ["\n".join(r) for _, r in pairs]))
    got = text_metrics.overlaps(hyps, refs, ns)
    assert got.shape == (len(pairs), len(ns) + 1, 4)
    for (hyp, rs), rows in zip(pairs, got.tolist()):
        h, rs = hyp.split(), [r.split() for r in rs]
        nearest = min((abs(len(r) - len(h)), len(r)) for r in rs)[1]
        assert rows[0] == [0, len(h), nearest, 0]
        for n, row in zip(ns, rows[1:]):
            most = collections.Counter()
            for r in rs:
                most |= grams(r, n)
            mine = grams(h, n)
            assert row == [n, (mine & most).total(), mine.total(), sum(grams(r, n).total() for r in rs)]


def test_overlap_of_nulls_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(text_metrics, "SLICE_BYTES", 8)
    rows = [(1, "a b c", ["a b", None]), (1, None, ["a"]), (2, "a b", None), (3, "", []), (3, "a a b", ["a b", "a a"]), (None, "a b c d", ["a b c d"])]
    df = spark.createDataFrame(rows, "id int, hyp string, refs array<string>").coalesce(1)
    row = text_metrics.corpus_bleu(df, max_n=2).first()
    assert (row.matched_1, row.total_1, row.matched_2, row.total_2) == (9, 12, 6, 8)
    assert (row.hyp_len, row.ref_len, row.n_pairs) == (12, 9, 6)
    assert text_metrics.corpus_bleu(df.limit(0)).first()["n_pairs"] == 0


def lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return int(best[-1, -1])


def test_rouge(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(0, 90)))
    pairs = [(i, text(), text()) for i in range(40)] + [(90, "", ""), (91, "a", ""), (92, "", "a")]
    df = spark.createDataFrame(pairs, "id int, hyp string, ref string")
    long = {r["id"]: r for r in text_metrics.rouge_l(df).collect()}
    short = {(r["id"], r["n"]): r for r in text_metrics.rouge_n(df).collect()}
    for i, hyp, ref in pairs:
        h, r = hyp.split(), ref.split()
        assert long[i]["lcs"] == lcs(h, r)
        for n in (1, 2):
            both = sum((grams(h, n) & grams(r, n)).values())
            row = short[i, n]
            assert row["recall"] == pytest.approx(both / max(1, len(r) - n + 1))
            assert row["precision"] == pytest.approx(both / max(1, len(h) - n + 1))
    mean = text_metrics.mean_scores(text_metrics.rouge_l(df)).first()
    assert mean["n_pairs"] == 43 and 0 < mean["f1"] < 1


def test_weighted_f1_with_a_class_missing_in_the_truth(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (1, 2), (0, 0)]
    row = text_metrics.weighted_f1(spark.createDataFrame(rows, "t int, p int"), "t", "p").first()
    f0, f1 = 2 * 2 / (3 + 2), 2 * 2 / (3 + 3)
    assert row["weighted_f1"] == pytest.approx((f0 * 3 + f1 * 3) / 6)
    assert (row["n"], row["n_classes"]) == (6, 2)


def test_perplexity(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "b int, loss double")
    assert text_metrics.perplexity(df, "loss", "b").first()[1] == pytest.approx(math.exp(3.5))
    assert text_metrics.perplexity(df, "loss", mode="micro").first()[1] == pytest.approx(math.exp(3.0))
    docs = spark.createDataFrame([(0, "a a b"), (1, "c")], "doc_id int, text string")
    got = {r["doc_id"]: r["perplexity"] for r in text_metrics.unigram_perplexity(docs).collect()}
    p = {"a": 3 / 7, "b": 2 / 7, "c": 2 / 7}
    assert got[0] == pytest.approx((p["a"] ** 2 * p["b"]) ** (-1 / 3)) and got[1] == pytest.approx(3.5)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_exact_quantiles(spark, by):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.choice([rng.random(), 0.5, 2.0])) for i in range(600)]
    df = spark.createDataFrame(rows + [("hot", None)], "g string, x double").repartition(4)
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r["g"] if by else None, r["q"]): r["quantile"] for r in quantiles.exact_quantiles(df, by, "x", qs).collect()}
    groups = {g for g, _ in rows} if by else {None}
    for g in groups:
        values = [x for h, x in rows if g is None or h == g]
        for q in qs:
            assert got[g, q] == pytest.approx(float(np.quantile(values, q)))
    assert len(got) == len(groups) * len(qs)


def test_run_metrics(spark):
    runs = spark.sql(
        """SELECT * FROM VALUES ('f', timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:02'),
        ('f', timestamp'2024-01-01 00:00:01', timestamp'2024-01-01 00:00:05') AS t(kind, a, b)"""
    )
    row = run_metrics.latency(runs, "a", "b", ["kind"]).first()
    assert (row["n_runs"], row["mean_s"], row["p50_s"]) == (2, 3.0, 3.0)
    row = run_metrics.throughput(runs, "a", ["kind"]).first()
    assert (row["n_items"], row["items_per_s"]) == (2, 2.0)
    assert run_metrics.throughput(runs.limit(1), "a", ["kind"]).first()["items_per_s"] is None


def test_consistency(spark):
    rows = [("a", i, 7 if i in (0, 3, 4) else 100 + i) for i in range(10)] + [("b", 0, 1)]
    df = spark.createDataFrame(rows, "k string, run int, h int")
    got = {r["k"]: (r["n_same"], r["score"], r["score_of_rest"]) for r in run_metrics.consistency(df, ["k"], "run", "h").collect()}
    assert got["a"] == (2, 20.0, pytest.approx(200 / 9)) and got["b"] == (0, 0.0, None)


def test_length_classes_and_cost(spark):
    df = spark.createDataFrame([(1,), (1024,), (1025,), (9000,)], "n int")
    got = [r[0] for r in df.select(run_metrics.length_class(F.col("n"))).collect()]
    assert got == [1024, 1024, 2048, None]
    row = df.where("n = 1024").select(
        run_metrics.attention_flops(F.col("n"), 1024, 8), run_metrics.attention_tflops(F.col("n"), F.lit(0.0))
    ).first()
    assert tuple(row) == (4.0 * 1024 * 1024 * 1024, None)


def test_loss_summary(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(250)], "step int, loss double").repartition(3)
    rows = run_metrics.loss_summary(df).orderBy("window_no").collect()
    assert [(r["logged_loss"], r["last_loss"], r["n_steps"]) for r in rows] == [(0.0, 99.0, 100), (100.0, 199.0, 100), (200.0, 249.0, 50)]
