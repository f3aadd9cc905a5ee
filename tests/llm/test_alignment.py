import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm.conftest import ODD, documents

from weftline.llm import alignment

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def tokenizers():
    with open(A) as f, open(B, "rb") as g:
        return alignment._both(f.read(), g.read())


def token_bytes(libraries, text):
    """(id, bytes) of both tokenizers by the libraries, each text as a whole."""
    first, second = libraries
    byte = alignment.byte_of_char()
    a = [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:-1], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def brute(libraries, texts):
    docs = []
    for text in texts:
        a, b = token_bytes(libraries, text) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        spans = []
        for tokens in (a, b):
            ends = np.cumsum([len(x) for _, x in tokens]).tolist()
            spans.append([(i, e - len(x), e) for (i, x), e in zip(tokens, ends)])
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [
            "|".join(",".join(str(i) for i, s, e in tokens if lo < e <= hi) for tokens in spans) for lo, hi in zip([0, *cuts], cuts)
        ]
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = {}
    for *_, links, _ in docs:
        for pair in set(links):
            count[pair] = count.get(pair, 0) + 1
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return [
        (n_a, n_b, n_g, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest)
        for n_a, n_b, n_g, links, digest in docs
    ]


TEXTS = [
    "The river ran high; people's lamps burned.", "x", " ", "  two  spaces ", "tab\tand\n\nlines \r\n", "café naïve Ünïcode — “quotes”",
    "你好，世界 こんにちは", "😀😀 a😀b", "<s></s><unk><0x41><|endoftext|> <|startoftext|>", "U+2581 ▁ here", "▁", "a b　c  d",
    "1234567890 3.14 1,000", "don't can't I'll we've", "\x00\x01 \x1c \x85", "a" * 700, "ab " * 300, "=" * 100, "é é ﬁ ½",
    None, "", "The river ran high; people's lamps burned.",
]


def result(spark, texts, **options):
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)], ["pairs", "times", "row", "n_a", "pair"])
    rows = alignment.align(docs, A, B, **options).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_as_by_the_libraries(spark, libraries):
    assert result(spark, TEXTS) == brute(libraries, TEXTS)


def test_joined_pairs_give_the_same(spark, libraries):
    assert result(spark, TEXTS, max_pairs=0) == brute(libraries, TEXTS)


def test_random_texts(spark, libraries):
    rng = random.Random(4)
    alphabet = [*"abcdefgh ,.'\n\t", "  ", " the", "é", "ß", "世", "😀", " ", "_", "3", "("]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(300)]
    assert result(spark, texts) == brute(libraries, texts)


def test_parts_give_the_ids_of_the_whole(tokenizers, libraries, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "CACHE", 500)
    rng = random.Random(9)
    texts = ["".join(rng.choices([*"aeiou xyz.,;:!?()[]'\"\n\t\\/", "  ", " word", "ing", "ö", "中"], k=rng.randint(1, 60))) for _ in range(2000)]
    for begin in range(0, len(texts), 300):
        some = texts[begin : begin + 300]
        ids, border = alignment.encode(pa.array(some), tokenizers)
        for i, text in enumerate(some):
            want = token_bytes(libraries, text)
            for k in (0, 1):
                assert ids[k][border[k][i] : border[k][i + 1]].tolist() == [t for t, _ in want[k]]


@pytest.mark.parametrize("seed", range(20))
def test_gallop_finds_the_first_end_not_below(seed):
    rng = np.random.default_rng(seed)
    long = np.unique(rng.integers(0, 4000, rng.integers(1, 3000)))
    long = np.append(long, 4001)
    short = np.append(np.unique(rng.integers(0, 4000, rng.integers(1, 400))), 4001)
    want = np.searchsorted(long, short)
    assert alignment.gallop(short, long, np.zeros(len(short), np.int64)).tolist() == want.tolist()
    assert alignment.gallop(short, long, np.maximum(want - rng.integers(0, 50, len(want)), 0)).tolist() == want.tolist()


def test_odd_rows(spark, odd, none, libraries):
    got = sorted(tuple(r)[1:5] for r in alignment.align(odd, A, B).collect())
    texts = [t for _, t, *_ in ODD]
    short = brute(libraries, [t if t and len(t) < 5000 else None for t in texts])
    for t, row in zip(texts, short):
        if not t or len(t) < 5000:
            assert row[:4] in got
    assert len(got) == len(ODD)
    long = [len(x) for x in token_bytes(libraries, ODD[11][1])]
    assert any(list(r[:2]) == long for r in got)
    assert alignment.align(none, A, B).count() == 0
