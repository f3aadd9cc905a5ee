import random
import re

import numpy as np
import pytest

from llm.conftest import ODD, documents
from weftline.llm import suffix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=suffix.MIN_WORDS):
    """Merged spans of windows of n words that two different documents have."""
    owners, places = {}, []
    for doc, text, *_ in rows:
        found = list(WORDS.finditer(text or ""))
        for i in range(len(found) - n + 1):
            window = tuple(m.group() for m in found[i : i + n])
            owners.setdefault(window, set()).add(doc)
            places.append((doc, i, found[i].start(), found[i + n - 1].end(), window))
    out = []
    hit = sorted({(d is None, d or 0, i, a, b) for d, i, a, b, w in places if len(owners[w]) > 1})
    for none, doc, i, a, b in hit:
        if out and out[-1][:2] == [none, doc] and i <= out[-1][3]:
            out[-1][3], out[-1][5] = max(out[-1][3], i + n), max(out[-1][5], b)
        else:
            out.append([none, doc, i, i + n, a, b])
    return sorted(tuple(x) for x in out)


def spans(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.start_word, r.end_word, r.start, r.end) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([20, 49, 50, 51, 70, 300]))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(len(p))])
            at = rng.randint(0, len(words))
            words[at:at] = p[a:] if rng.random() < 0.7 else p[: len(p) - a]
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\té "]) for w in words)))
    rows += [(500, "the same word " * 60), (501, "x y " * 100), (502, "y x " * 100), (503, rows[0][1]), (504, " ".join(["z"] * 300)), (505, " ".join(["z"] * 51))]
    got = suffix.repeated_spans(documents(spark, rows))
    assert spans(got) == brute(rows)
    assert all(r.n_words == r.end_word - r.start_word >= 50 for r in got.collect())


def test_odd_rows(spark, odd, none):
    assert spans(suffix.repeated_spans(odd)) == brute(ODD)
    assert suffix.repeated_spans(none).count() == 0


def test_a_passage_of_very_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} " * (i % 5) + passage + f" end{i}") for i in range(3000)]
    got = suffix.repeated_spans(documents(spark, rows)).collect()
    assert len(got) == 3000 and all(r.n_words == 60 and r.start_word == r.doc_id % 5 for r in got)


def test_leftmost_smallest_of_a_window():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 18, 27):
        values = rng.integers(0, 6, 200).astype(np.uint64)
        got = suffix._prefix_min(values, width)
        assert got.tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]


@pytest.mark.parametrize("n", [8, 20, 30])
def test_short_passages_equal_brute_force(spark, n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([n - 1, n, n + 1, 3 * n]))] for _ in range(12)]
    rows = []
    for doc in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(passages) + [rng.choice(vocabulary) for _ in range(rng.randint(0, 10))]
        rows.append((doc, " ".join(words)))
    want = brute(rows, n)
    assert want and spans(suffix.repeated_spans(documents(spark, rows), n)) == want


def test_passages_below_a_gram_are_an_error(spark):
    with pytest.raises(ValueError):
        suffix.repeated_spans(documents(spark, [(1, "a b")]), suffix.GRAM - 1)
