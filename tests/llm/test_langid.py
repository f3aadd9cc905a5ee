import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.conftest import ODD, documents
from weftline.llm import langid

SYLLABLES = {"aa": "the of and ing tion er st re".split(), "bb": "der die und sch keit ver ung ge".split(), "cc": "el la que ción os ar mente do".split()}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40)))
        rows.append((i, text.capitalize() + ".", lang))
    return rows


def brute_model(counts):
    """Interpolated Kneser-Ney with one discount per order, from counts of tuples of four symbols."""
    tables = {langid.ORDER: Counter(counts)}
    for order in range(langid.ORDER - 1, 0, -1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])

    def prob(gram):
        order = len(gram)
        if order == 0:
            return 1 / langid.SYMBOLS
        table = tables[order]
        once, twice = (sum(c == k for c in table.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once else 0.5
        same = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        if not same:
            return prob(gram[1:])
        return max(table[gram] - discount, 0) / sum(same) + discount * len(same) / sum(same) * prob(gram[1:])

    return prob


def test_model_equals_brute_force():
    words = ["abba", "ab", "cab", "bacca", "é", "abé"] * 2 + ["ba"]
    gram, _ = langid.symbols(words)
    codes, n = np.unique(gram, return_counts=True)
    m = langid.model("x", codes, n)

    def parts(code):
        return tuple(int(code) >> langid.BITS * i & langid.SYMBOLS - 1 for i in range(langid.ORDER - 1, -1, -1))

    prob = brute_model({parts(c): int(k) for c, k in zip(codes, n)})
    asked, _ = langid.symbols(["abba", "abc", "zzz", "caé", "b"])
    assert langid.log_probs(m, asked) == pytest.approx([math.log2(prob(parts(c))) for c in asked], abs=1e-4)
    for context in (0, 1 << 12 | 2 << 6 | 2, 9):
        every = np.array([context << langid.BITS | s for s in range(langid.SYMBOLS)])
        assert (2 ** langid.log_probs(m, every)).sum() == pytest.approx(1, abs=1e-4)


def test_symbols_of_words():
    gram, border = langid.symbols(["ab", "é"])
    assert border.tolist() == [0, 3, 5]
    assert gram.tolist()[:3] == [1, 1 << 6 | 2, 1 << 12 | 2 << 6]
    assert langid.symbols([])[0].tolist() == []


def test_entropy_of_a_text_is_that_of_its_words():
    words = ["the", "of", "and"] * 5
    gram, _ = langid.symbols(words)
    codes, n = np.unique(gram, return_counts=True)
    m = langid.model("x", codes, n)
    bits, count = langid.entropies([m], pa.array(["The of, THE", None, "12 !", "of"]))
    gram, border = langid.symbols(["the", "of", "the"])
    assert count.tolist() == [11, 0, 0, 3]
    assert bits[0, 0] == pytest.approx(-langid.log_probs(m, gram).sum() / 11, abs=1e-6)
    assert np.isnan(bits[1, 0]) and np.isnan(bits[2, 0])


def test_counts_equal_brute_force(spark):
    rows = corpus(60)
    want = defaultdict(Counter)
    for _, text, lang in rows:
        gram, _ = langid.symbols([w for w in text.lower().rstrip(".").split()])
        want[lang].update(gram.tolist())
    got = defaultdict(dict)
    for r in langid.counts(documents(spark, rows)).collect():
        got[r.lang][r.gram] = r.n
    assert got == want


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in langid.identify(docs, langid.remainder() != 1).collect()}
    assert len(got) == len(rows)
    right = [got[i].lang_pred == lang for i, _, lang in rows]
    assert np.mean(right) >= 0.99
    assert all(0 <= r.score <= 1 for r in got.values()) and np.mean([r.score for r in got.values()]) > 0.9


def test_labels_of_held_out_rows_are_never_used(spark):
    docs = documents(spark, corpus())
    wrong = docs.withColumn("lang", F.when(langid.remainder() == 1, F.lit("xx")).otherwise(F.col("lang")))
    a = langid.identify(docs, langid.remainder() != 1).collect()
    b = langid.identify(wrong, langid.remainder() != 1).collect()
    assert sorted(a) == sorted(b)


def test_far_texts_are_rejected(spark):
    rows = corpus() + [(10_000, "qxzj " * 60, None)]
    got = langid.identify(documents(spark, rows), F.lit(True)).where("doc_id = 10000").first()
    assert got.rejected


def test_odd_rows(spark, odd, none):
    got = langid.identify(odd, F.lit(True)).collect()
    assert len(got) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3)), got
    assert {r.lang_pred for r in got} <= {"und", "en", "zz"}
    assert langid.identify(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}
