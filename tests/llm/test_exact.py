import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import ODD, PROSE, documents
from weftline.llm import exact, fuse


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((len(text), doc_id))
    best = {}
    for normal, own in groups.items():
        longest = max(n for n, _ in own)
        ids = [d for n, d in own if n == longest]
        best[normal] = min((d for d in ids if d is not None), default=None), len(own)
    return [(d, *best[re.sub(r"[\x20\x09-\x0D]", "", t or "")]) for d, t, *_ in rows]


def key(row):
    return tuple((v is None, v or 0) for v in row)


def random_rows(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["a", "b", "ab", "é"]) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    return [(i, rng.choice(texts) + rng.choice(["", " ", "\n\t"])) for i in range(300)]


def few(text):
    """A digest of three bits, so that most texts clash."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 1).cast("binary")


@pytest.mark.parametrize("digest", [exact.sha256, few])
def test_groups_equal_brute_force(spark, digest):
    rows = random_rows(3) + [(1000 + i, t) for i, t in enumerate(["x y", "xy", "x\ny ", "XY", " xy"])]
    stored = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = exact.exact_dedup(documents(spark, rows), stored, digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


@pytest.mark.parametrize("share", ["true", "false", "cast(null as boolean)"])
def test_any_split_into_snapshot_and_batch_gives_the_same(spark, share):
    rows = random_rows(4)
    got = exact.exact_dedup(documents(spark, rows), F.expr(share)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted(brute(rows))


def test_odd_rows(spark, odd, none):
    stored = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = exact.exact_dedup(odd, stored).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=key) == sorted(brute(ODD), key=key)
    prose = [r for r in got if r.keep_id == 5]
    assert len(prose) == 4 and sum(r.kept for r in prose) == 1
    assert exact.exact_dedup(none, stored).count() == 0


def test_keep(spark, odd, none):
    kept = exact.keep(odd, F.lit(True))
    rows = kept.collect()
    assert kept.columns == odd.columns
    assert sorted(r.text for r in rows if r.doc_id == 5) == [PROSE]
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in ODD})
    assert exact.keep(none, F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    f = fuse.build(keys)
    assert fuse.contains(f, keys).all()
    others = np.setdiff1d(rng.integers(0, 2**63, 200_000, dtype=np.uint64), keys)
    assert fuse.contains(f, others).mean() < 1e-3 or n < 3
    assert n < 1000 or len(f.slots) < 1.6 * n + 200
