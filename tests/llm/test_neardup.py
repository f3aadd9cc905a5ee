import random
import re

import numpy as np
import pytest

from llm.conftest import ODD, PROSE, documents
from weftline.llm import neardup
from weftline.llm.neardup import Params, keys, near_dedup


def brute(rows, k, percent):
    """Component of each row: the smallest doc_id that links of full sets reach."""
    sets = []
    for _, text, *_ in rows:
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", folded)
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    members = {}
    for i, row in enumerate(rows):
        members.setdefault(root(i), []).append(row[0])
    low = {r: min((d for d in ids if d is not None), default=None) for r, ids in members.items()}
    return [(rows[i][0], len(sets[i]), low[root(i)]) for i in range(len(rows))]


def copies(seed, families, size):
    """Families of near copies around both sides of the threshold, short texts, and a shared passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120, 400]))] + shared * rng.randint(0, 1)
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    rows = copies(k, 50, 7)
    got = near_dedup(documents(spark, rows), Params(shingle=k, percent=percent)).collect()
    want = brute(rows, k, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_blocks_find_links_across_components(spark, monkeypatch):
    # The smallest node of a key is far from the others, so links are left to the second step.
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(1)
    rows, base = [], [f"w{i}" for i in range(300)]
    for _ in range(24):
        words = list(base)
        for _ in range(rng.randint(4, 9)):
            words[rng.randrange(300)] = f"n{rng.random()}"
        rows.append((len(rows), " ".join(words)))
    got = near_dedup(documents(spark, rows), Params(shingle=3, percent=85)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))


def test_odd_rows(spark, odd, none):
    got = near_dedup(odd, Params(shingle=3, percent=85)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    want = [(d, n, d if n == 0 else c) for d, n, c in brute(ODD, 3, 85)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert near_dedup(none).count() == 0


def test_keep_leaves_one_row_of_each_component(spark, odd, none):
    kept = neardup.keep(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [r.text for r in rows if r.text == PROSE or r.text == PROSE.upper()]
    assert len(texts) == 1
    assert sum(r.text is None for r in rows) == 2 and sum(r.text == "" for r in rows) == 1
    assert neardup.keep(none).count() == 0


def test_radius_bounds_the_miss():
    p = Params(shingle=3, percent=85)
    rng = np.random.default_rng(0)
    errors = rng.binomial(p.n_hashes, 0.15, 1_000_000)
    assert (errors > p.radius).mean() <= 1e-5


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_signatures_within_the_radius_share_a_key(percent):
    p = Params(percent=percent)
    rng = np.random.default_rng(percent)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, p.n_hashes).astype(np.uint16)
        b = a.copy()
        b[rng.choice(p.n_hashes, p.radius, replace=False)] ^= 1
        found = keys(np.stack([a, b]), p)
        assert (found[0] == found[1]).any()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
