import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from llm.conftest import ODD
from weftline.llm import bpe

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = ["a", "b", "aa", "the", "é", "\n", " ", "  ", "😀", "1", "'s", " ", " ", "\x1c", "\x85", ", ", ". ", "\t", "word ", " x", "ab" * 30]


@pytest.fixture(scope="module")
def codec():
    with open(RANK_FILE, "rb") as f:
        return bpe.Codec(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def encode(codec, texts):
    ids, border = codec.encode(pa.array(texts, pa.string()))
    data, ends = codec.decode(ids, border)
    assert [data[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [(t or "").encode() for t in texts]
    return [ids[a:b].tolist() for a, b in zip(border, border[1:])]


def test_ids_equal_the_library(codec, library):
    rng = random.Random(1)
    for n in range(200):
        alphabet = ALPHABET if n % 2 else [a for a in ALPHABET if a.strip() and " " not in a] + [" "]
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))] + [None]
        assert encode(codec, texts) == [library.encode_ordinary(t or "") for t in texts]


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "=-" * 2000, " " * 3000, "é" * 1000, "the" * 900])
def test_long_matches(codec, library, text):
    assert encode(codec, [text]) == [library.encode_ordinary(text)]


def test_a_very_long_match(codec, library):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    assert encode(codec, [text]) == [library.encode_ordinary(text)]


def test_long_parts_are_split_bit_by_bit(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_CHARS", 10)
    monkeypatch.setattr(bpe, "MATCHES", 3)
    codec.parts.known.clear()
    text = "x.y,z;" * 9 + "end"
    assert encode(codec, [text, "a b"]) == [library.encode_ordinary(t) for t in (text, "a b")]


def merge_one_by_one(ranks, piece):
    parts = [bytes([c]) for c in piece]
    while True:
        found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_any_rank_table_merges_the_lowest_rank_first():
    # Random tables, in which a merge may open a pair of a lower rank.
    rng = random.Random(3)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(40):
            token = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
            if token not in tokens and len(token) < 9:
                tokens.append(token)
        extra = tokens[256:]
        rng.shuffle(extra)
        ranks = {t: i for i, t in enumerate(tokens[:256] + extra)}
        merges = bpe.Merges(ranks)
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(8)]
        ids, border = merges.run(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]))
        for piece, a, b in zip(pieces, border, border[1:]):
            assert ids[a:b].tolist() == merge_one_by_one(ranks, piece)


def test_a_chain_with_a_lower_merge_inside():
    tokens = [bytes([b]) for b in range(256)]
    ranks = {t: i for i, t in enumerate([*tokens, b"aaa", b"aa", b"aaaa"])}
    merges = bpe.Merges(ranks)
    for n in range(1, 40):
        ids, _ = merges.run(np.frombuffer(b"a" * n, np.uint8), np.array([0, n]))
        assert ids.tolist() == merge_one_by_one(ranks, b"a" * n)


def test_rank_set():
    rng = random.Random(5)
    ours, held = bpe.RankSet(50_000), set()
    for _ in range(3000):
        rank = rng.randrange(50_000)
        if rng.random() < 0.6 or not held:
            ours.add(rank)
            held.add(rank)
        else:
            first = ours.first()
            assert first == min(held)
            ours.remove(first)
            held.discard(first)


def test_queries_over_odd_rows(spark, odd, none, library):
    got = bpe.round_trip(odd, RANK_FILE, public_tokenizers.PATTERN).collect()

    def want(text):
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want(t) for _, t, *_ in ODD)
    assert bpe.round_trip(none, RANK_FILE, public_tokenizers.PATTERN).count() == 0
    ids = bpe.encoded(odd, RANK_FILE, public_tokenizers.PATTERN)
    back = bpe.decoded(ids, RANK_FILE, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t, *_ in ODD)


def test_read_ranks():
    assert bpe.read_ranks(base64.b64encode(b"ab") + b" 7\n\n") == {b"ab": 7}
