import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import ids as I
from weftline.operators import bpe, lookup, vocabulary

TEXTS = ["the cat the dog", "", "the the the the end", "Straße café 12 été", "...", "cat"]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def split(text):
    return re.findall(r"[^\W_]+", text)


def test_vocab_order_and_ids(corpus):
    counts = collections.Counter(w for t in TEXTS for w in split(t))
    want = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    for size in (None, 4):
        got = vocabulary.build_vocab(vocabulary.count_words(corpus), size).orderBy("id").collect()
        assert [(r["token"], r["id"]) for r in got] == [(w, 12 + i) for i, w in enumerate(want[:size])]


def test_encode_in_place_and_by_join_agree(corpus, monkeypatch):
    vocab = vocabulary.build_vocab(vocabulary.count_words(corpus), 4)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    want = {i: [ids.get(w, I.UNK) for w in split(t)] for i, t in enumerate(TEXTS)}
    assert {r[0]: r[1] for r in vocabulary.encode(corpus, vocab).collect()} == want
    monkeypatch.setattr(vocabulary, "BROADCAST_ROWS", 1)
    assert {r[0]: r[1] for r in vocabulary.encode(corpus, vocab).collect()} == want


@pytest.mark.parametrize("head_rows", [0, 1, 3, 100])
def test_lookup_keeps_every_row(spark, head_rows):
    rows = [("hot",)] * 500 + [(f"k{i % 20}",) for i in range(100)] + [("missing",), (None,)]
    table = [("hot", 500, 0)] + [(f"k{i}", 5, i + 1) for i in range(20)] + [("x" * 300, 1, 99)]
    left = spark.createDataFrame(rows, "key string")
    right = spark.createDataFrame(table, "key string, w int, v int")
    got = collections.Counter(
        (r["key"], r["v"]) for r in lookup.lookup(left, right, "key", "w", head_rows).collect()
    )
    values = {k: v for k, _, v in table}
    assert got == collections.Counter((k, values.get(k)) for (k,) in rows)


def test_a_hot_key_of_any_length_is_broadcast(spark, monkeypatch):
    hot = "x" * 3000
    table = spark.createDataFrame([(hot, 900, [1]), ("b", 5, [2]), ("c", 4, list(range(500)))], "key string, w int, v array<int>")
    rows = spark.createDataFrame([(hot,)] * 900 + [("b",), ("c",), ("none",), (None,)], "key string")
    for size in (1, 2):
        got = lookup.lookup(rows, table, "key", "w", size).groupBy("key", "v").count().collect()
        assert {(r["key"], r["v"] and len(r["v"])): r["count"] for r in got} == {
            (hot, 1): 900, ("b", 1): 1, ("c", 500): 1, ("none", None): 1, (None, None): 1
        }
        assert [r["w"] for r in lookup.head_of(table, "key", "w", size).orderBy("w").collect()][-1] == 900
    # Values beyond the bytes of the head stay behind.
    monkeypatch.setattr(lookup, "HEAD_BYTES", 200)
    assert sorted(r["w"] for r in lookup.head_of(table, "key", "w").collect()) == [5, 900]


def test_embeddings_broadcast_and_salted_agree(spark, monkeypatch):
    table = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(5)], "token_id int, vec array<float>")
    ids = spark.createDataFrame([(p, i) for p, i in enumerate([1, 2, 2, 2, 4, 9])], "pos int, id int")
    want = {0: [0.0, 0.0], 1: [2.0, -2.0], 2: [2.0, -2.0], 3: [2.0, -2.0], 4: [4.0, -4.0], 5: None}
    assert {r["pos"]: r["vec"] for r in vocabulary.lookup_embeddings(ids, table, 2).collect()} == want
    monkeypatch.setattr(vocabulary, "BROADCAST_ROWS", 1)
    assert {r["pos"]: r["vec"] for r in vocabulary.lookup_embeddings(ids, table, 2).collect()} == want


def learn(counts, n):
    """One merge per round, straight from the definition."""
    words = {w: list(w) for w in counts}
    merges = []
    for _ in range(n):
        pairs = collections.Counter()
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p[0].encode(), p[1].encode()))
        merges.append((*best, pairs[best]))
        for w, s in words.items():
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == best:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            words[w] = out
    return merges, words


def random_counts(seed):
    rng = random.Random(seed)
    return {
        "".join(rng.choice("aab" if seed % 2 else "abcé") for _ in range(rng.randint(1, 9))): rng.randint(1, 30)
        for _ in range(60)
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_one_merge_per_round(spark, seed):
    counts = random_counts(seed)
    want, words = learn(counts, 14)
    df = spark.createDataFrame(list(counts.items()), "token string, count bigint")
    merges = bpe.train_bpe(df, 14)
    got = [(r["left"], r["right"], r["count"]) for r in merges.orderBy("rank").collect()]
    assert got == want
    rows = spark.createDataFrame([(0, list(counts)), (1, []), (2, None), (3, ["zz", "ab"])], "k int, w array<string>")
    coded = {r["k"]: r["symbols"] for r in bpe.encode_bpe(rows, "w", merges).collect()}
    assert coded[0] == [s for w in counts for s in words[w]]
    assert coded[1] == [] and coded[2] is None and coded[3][:2] == ["z", "z"]


def test_merges_stop_when_no_pair_is_left(spark):
    df = spark.createDataFrame([("ab", 3), ("c", 9)], "token string, count bigint")
    assert [tuple(r) for r in bpe.train_bpe(df, 10).collect()] == [(0, "a", "b", 3)]


@pytest.mark.parametrize("seed", range(8))
def test_grouped_merges_are_those_of_single_rounds(seed):
    """The rule that takes several merges in one round, on plain lists."""
    counts = random_counts(seed)
    want, _ = learn(counts, 25)
    words = {w: list(w) for w in counts}
    got, products = [], set()
    while len(got) < 25:
        pairs = collections.Counter()
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] += counts[w]
        ranked = sorted(pairs, key=lambda p: (-pairs[p], p[0].encode(), p[1].encode()))
        rows = [{"left": a, "right": b, "count": pairs[a, b]} for a, b in ranked]
        batch = bpe._independent(rows, products, 25 - len(got))
        if not batch:
            break
        for r in batch:
            got.append((r["left"], r["right"], r["count"]))
            mark = lambda s: "".join(f"<{x}>" for x in s)
            old, new = f"<{r['left']}><{r['right']}>", f"<{r['left'] + r['right']}>"
            words = {w: mark(s).replace(old, new)[1:-1].split("><") for w, s in words.items()}
    assert got == want


def rescanned(word, rank):
    parts = list(word)
    while True:
        found = [p for p in zip(parts, parts[1:]) if p in rank]
        if not found:
            return parts
        best, out = min(found, key=rank.get), []
        for part in parts:
            # A symbol just made is longer than the right side, so it is never taken for the left one.
            if out and (out[-1], part) == best:
                out[-1] += part
            else:
                out.append(part)
        parts = out


@pytest.mark.parametrize("seed", range(20))
def test_any_merge_list_gives_the_symbols_of_a_rescan(seed):
    """Lists no training would give too: products of several merges, later ones ranked lower."""
    rng = random.Random(seed)
    symbols, pairs = list("abc"), {}
    while len(pairs) < rng.choice([3, 12, 40]):
        pair = rng.choice(symbols), rng.choice(symbols)
        if pair not in pairs:
            pairs[pair] = None
            symbols.append("".join(pair))
    order = list(pairs) if seed % 2 else rng.sample(list(pairs), len(pairs))
    rank = {p: i for i, p in enumerate(order)}
    for _ in range(300):
        word = "".join(rng.choice("aabc") for _ in range(rng.choice([0, 1, 2, 3, 8, 40])))
        assert bpe._split(word, rank) == rescanned(word, rank)


def test_a_text_of_one_word_takes_little_more_than_linear_time():
    rank = {("a" * 2**i, "a" * 2**i): i for i in range(5)} | {("a" * 32, "b"): 5}
    rank |= {(chr(200 + i), chr(201 + i)): 6 + i for i in range(0, 4000, 2)}
    tail = [chr(200 + i) for i in range(4000)]
    word = "a" * 320_000 + "b" + "".join(tail)
    assert bpe._split(word, rank) == ["a" * 32] * 9_999 + ["a" * 32 + "b"] + [a + b for a, b in zip(tail[::2], tail[1::2])]


def test_words_and_positions(corpus):
    rows = vocabulary.tokenize_words(corpus).orderBy("doc_id", "pos").collect()
    assert [(r[0], r[1], r[2]) for r in rows] == [
        (d, p, w) for d, t in enumerate(TEXTS) for p, w in enumerate(split(t))
    ]
    assert corpus.select(F.size(I.words("text"))).collect()[3][0] == 4
