import random

import pytest
from llm.conftest import documents
from pyspark.sql import functions as F

from weftline.llm import mixing


def by_source(df, k=0):
    out = {}
    for r in df.collect():
        s = out.setdefault(r.source, {"size": 0, "taken": 0, "target": r.mixes[k].target, "most": 0})
        s["size"] += r["size"]
        s["taken"] += r.mixes[k].taken
        s["most"] = max(s["most"], r["size"])
        assert 0 <= r.mixes[k].taken <= 3 * r["size"] and r.source_size >= r["size"]
    return out


def fill(sizes, budget, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = budget - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def made(spark, rng, n, sources):
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300]))) for i in range(n)]
    source = F.element_at(F.array(*[F.lit(s) for s in sources]), F.pmod(F.xxhash64("doc_id"), F.lit(len(sources))).cast("int") + 1)
    hot = F.when(F.col("doc_id") % 3 == 0, F.lit(sources[0])).otherwise(F.coalesce(source, F.lit(sources[-1])))
    return documents(spark, rows, ["size", "h", "tie", "_salt", "part", "k"]).withColumn("source", hot)


@pytest.mark.parametrize("seed", range(3))
def test_sources_come_near_their_targets(spark, seed):
    rng = random.Random(seed)
    docs = made(spark, rng, 3000, ["b", "a", "é", "Z", None, "", "zz"])
    got = by_source(mixing.mix(docs))
    want = fill({s: v["size"] for s, v in got.items()}, sum(v["size"] for v in got.values()))
    for source, v in got.items():
        assert v["target"] == pytest.approx(want[source])
        assert abs(v["taken"] - v["target"]) <= v["most"] / 2 + 1


def test_one_small_source_is_capped_and_its_excess_shared(spark):
    docs = documents(spark, [(1, "one two"), *[(i, "w " * 50) for i in range(2, 60)]])
    docs = docs.withColumn("source", F.when(F.col("doc_id") == 1, "tiny").otherwise(F.when(F.col("doc_id") % 4 == 0, "a").otherwise("b")))
    got = by_source(mixing.mix(docs))
    assert got["tiny"] == {"size": 2, "taken": 6, "target": 6.0, "most": 2}
    assert sum(v["target"] for v in got.values()) == pytest.approx(sum(v["size"] for v in got.values()))


def test_budgets_are_nested_and_reruns_agree(spark):
    docs = made(spark, random.Random(7), 1500, ["a", "b", "c", "d"])
    budgets = (0.1, 0.5, 1.0, 2.0, 5.0)
    one = sorted(mixing.mix(docs, budgets).collect(), key=lambda r: r.doc_id)
    for r in one:
        taken = [m.taken for m in r.mixes]
        assert taken == sorted(taken) and taken[-1] == 3 * r["size"]
    again = sorted(mixing.mix(docs.repartition(5, "n_chars"), budgets).collect(), key=lambda r: r.doc_id)
    assert one == again


def test_rows_that_repeat_each_other_are_split_exactly(spark):
    docs = documents(spark, [(None, "a b c")] * 900 + [(1, "x y")] * 50).withColumn("source", F.when(F.col("doc_id") == 1, "b").otherwise("a"))
    got = by_source(mixing.mix(docs, (0.5,)))
    # Two sources with weights 1 and 2; b is capped at three times 100 words.
    assert got["b"]["taken"] == 300 and abs(got["a"]["taken"] - got["a"]["target"]) <= 2


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs = made(spark, random.Random(3), 800, ["a", "b", None])
    one = sorted(mixing.mix(docs, (0.3, 1.0)).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(mixing.mix(docs, (0.3, 1.0)).collect(), key=lambda r: r.doc_id) == one


def test_odd_rows(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and {r["size"] for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert sum(r.mixes[0].taken for r in got) > 0
    assert mixing.mix(none).count() == 0
    empty = mixing.mix(documents(spark, [(1, None), (2, " ")])).collect()
    assert [(r.mixes[0].target, r.mixes[0].taken) for r in empty] == [(0.0, 0)] * 2


def test_no_python_on_the_main_path(spark, odd):
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
