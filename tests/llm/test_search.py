import random

import numpy as np
import pytest
from llm.conftest import documents

from weftline.llm import search


def asked(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"item_id {kind}, text string, score string, query string")


def terms_of(text):
    out, held = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 128 or (c.isalnum() and c.isascii()):
            held += c.lower() if c.isascii() else c
        elif held:
            out.append(held)
            held = ""
    return out


def brute(docs, queries, k):
    """Scores by the definition, one document and query after the other."""
    import math

    docs = [(d, terms_of(t)) for d, t in docs if terms_of(t)]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, terms in docs:
        for term in set(terms):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in queries:
        scored = []
        for d, terms in docs:
            m, score = 75 + (25 * len(terms) * n_docs) // n_terms, 0
            for term in terms_of(text):
                tf = terms.count(term)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d if d is not None else 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


WORDS = ["the", "mill", "river", "Lamp", "é", "x1", "old", "rain", "door", "key"]


@pytest.mark.parametrize("seed", range(3))
def test_ranks_as_by_definition(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(search, "SCORE_BYTES", 4000)
    docs = [(i, rng.choice([", ", " ", "-"]).join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(150)]
    docs += [(rng.randrange(150), docs[0][1]) for _ in range(10)]
    queries = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))) for i in range(20)]
    got = search.rank(documents(spark, docs), asked(spark, [(*q, "s", "q") for q in queries]), 5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == brute(docs, queries, 5)


def test_shared_sums_are_those_of_the_terms():
    rng = random.Random(1)
    texts = [" ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += texts[:5] + [None, "", "w1 w1 w1"]
    block = search.read_block(texts)
    graph = search.share(block)
    parts = np.random.default_rng(0).integers(0, 1000, (len(block.terms), 17))
    want = np.zeros((len(texts), 17), np.int64)
    np.add.at(want, block.query, parts[block.term] * block.times[:, None])
    assert (graph.scores(parts) == want).all()
    adds = sum(len(left) for left, _ in graph.levels) + len(graph.nodes)
    assert graph.levels and adds < 0.8 * len(block.query)


def test_equal_queries_become_one_node():
    graph = search.share(search.read_block(["a b c d e"] * 4))
    assert np.diff(graph.border).tolist() == [1] * 4 and len(set(graph.nodes.tolist())) == 1


def test_ties_go_to_the_smallest_id(spark):
    docs = documents(spark, [(i, "same words here") for i in range(5000)] + [(i, "other text") for i in range(5000, 9000)]).repartition(13)
    got = rows(search.rank(docs, asked(spark, [(1, "same", "", ""), (1, "here", "", "")]), 3))
    assert [(r[1], r[2]) for r in got] == [(1, 0), (1, 0), (2, 1), (2, 1), (3, 2), (3, 2)]


def test_odd_rows(spark, odd, none):
    some = asked(spark, [(1, None, "", ""), (2, "", "", ""), (3, " .,", "", ""), (None, "river mill", "", ""), (4, "WORD word é", "", "")])
    got = rows(search.rank(odd, some, 20))
    assert {r[0] for r in got} == {None, 4}
    ranked = [r for r in sorted(got, key=lambda r: r[1]) if r[0] is None]
    # Prose stands five times; the two rows of document 5 come before 6, 9 (in capitals) and the one without an id.
    assert [r[2] for r in ranked] == [5, 5, 6, 9, None]
    assert search.rank(none, some).count() == 0
    assert search.rank(odd, some.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("é", "one")], "doc_id string, text string")
    got = rows(search.rank(docs, asked(spark, [("q", "two two", "", "")], "string"), 5))
    assert [r[:3] for r in got] == [("q", 1, "a"), ("q", 2, "b")]
