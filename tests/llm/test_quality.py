import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from llm.conftest import ODD, documents
from weftline.llm import quality

WORDS = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORDS, text or "")
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for found in places.values() if len(found) > 1 for i in found for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if re.search(WORDS, line)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


def counts(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [
        "".join(rng.choice(["a", "b ", "é ", "\n", "#x ", " \t", "same line\n", "one two three four five six seven eight "]) for _ in range(rng.randint(0, 60)))
        for _ in range(300)
    ]
    got = quality.quality(documents(spark, list(enumerate(texts)))).collect()
    assert sorted((r.doc_id, *counts(r)) for r in got) == sorted((i, *brute(t)) for i, t in enumerate(texts))


def test_odd_rows(spark, odd, none):
    got = quality.quality(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *counts(r)) for r in got) == sorted((d is None, d or 0, *brute(t)) for d, t, *_ in ODD)
    for r in got:
        if r.n_words == 0:
            assert not r.kept and r.class_distance is None and r.closest_lang is None
    assert quality.quality(none).count() == 0 and quality.keep(none).count() == 0
    assert quality.keep(odd).columns == odd.columns


def test_distance_is_the_jensen_shannon_distance():
    rng = np.random.default_rng(0)
    p, q = rng.integers(0, 5, 7), rng.random(7)
    q /= q.sum()
    share = p / p.sum()
    m = (share + q) / 2
    want = sum(a * math.log2(a / c) / 2 for a, c in zip(share, m) if a) + sum(b * math.log2(b / c) / 2 for b, c in zip(q, m) if b)
    assert quality.distance(p[None, :], q)[0] == pytest.approx(math.sqrt(want))
    assert quality.distance(q[None, :] * 3, q)[0] == pytest.approx(0, abs=1e-6)
    assert np.isnan(quality.distance(np.zeros((1, 7)), q)[0])


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(4)
    common = {"aa": "the of and to in is that was for with".split(), "bb": "der die und in den von zu das mit sich".split()}
    rare = {k: [f"{k}{''.join(rng.choice('abcdeiou') for _ in range(6))}" for _ in range(3000)] for k in common}

    def prose(lang, n=150):
        return " ".join(rng.choice(common[lang] if rng.random() < 0.5 else rare[lang]) for _ in range(n)) + "."

    good = [(i, prose("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(120)]
    junk = [
        (1000, " ".join(w + "%%%" for w in prose("aa").split()), "aa"),
        (1001, prose("aa").upper().replace(" ", "!! "), "aa"),
        (1002, " | ".join(rng.choice(rare["aa"]) for _ in range(150)), "aa"),
        (1003, "0x" + " 0x".join("%08x" % rng.getrandbits(32) for _ in range(150)), None),
    ]
    short = [(2000, " ".join(w + "%%%" for w in prose("aa", 19).split()), "aa"), (2001, "A B C " * 7, "aa")]
    got = {r.doc_id: r for r in quality.quality(documents(spark, good + junk + short)).collect()}
    assert all(got[i].kept for i, *_ in good)
    assert not any(got[i].kept for i, *_ in junk) and not any(got[i].base_failed for i, *_ in junk)
    assert got[2000].base_failed
    kept = {r.doc_id for r in quality.keep(documents(spark, good + junk + short)).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_no_language_keeps_what_the_base_keeps(spark):
    text = "some words that stay here for a long time " * 1 + " ".join(f"w{i}" for i in range(40))
    got = quality.quality(documents(spark, [(1, text, None)])).first()
    assert got.kept and got.class_distance is None


def test_references_are_bounded():
    rules = quality.Rules()
    assert 1 / rules.lang_share <= 100 and 1 / rules.word_share <= 250
    out = quality.judged(pa.array([], pa.string()), [], rules)
    assert len(out["kept"]) == 0


def test_rare_languages_are_not_lost(spark):
    rng = random.Random(6)

    def made(letters, n=3000):
        return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]

    def prose(common, rare, n=120):
        return " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)) + "."

    words = {"aa": (made("abcdeiou", 10), made("abcdeiou")), "ru": (made("абвгдеио", 10), made("абвгдеио")), "el": (made("αβγδειο", 10), made("αβγδειο"))}
    words["xx"] = made("klmnprstuy", 10), made("klmnprstuy")
    rows = [(i, prose(*words["aa"]), "aa") for i in range(4000)]
    rows += [(5000 + i, prose(*words["ru"]), "ru") for i in range(30)]  # below 1 %, enough words for a reference
    rows += [(6000, prose(*words["el"]), "el"), (6001, prose(*words["el"]), None), (6002, prose(*words["xx"]), "xx")]
    junk = [(7000 + i, " ".join(w + "%%%" for w in prose(*words["aa"]).split()), lang) for i, lang in enumerate(("aa", "ru", None))]
    docs = documents(spark, rows + junk)
    assert [r["lang"] for r in quality.references(docs)] == ["aa", "ru"]
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert all(got[i] for i, *_ in rows) and not any(got[i] for i, *_ in junk)
    assert {r.doc_id for r in quality.keep(docs).collect()} == {i for i, kept in got.items() if kept}
