import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm.conftest import ODD, PROSE, documents
from weftline.llm import packing

MODEL = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "B", "Σ", "ΟΔΟΣ", "the", "é", "é", "́", " ", "  ", "\n", "😀", "12", "'s", "İ", "ß", "ﬁ", "\x85", ", ", ".", "　", " x", "<|endoftext|>", "한국"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(MODEL)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(tokenizer):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [None]
    with open(MODEL, encoding="utf-8") as f:
        ids, border = packing.tokenized(pa.array(texts, pa.string()), f.read())
    got = [ids[a:b].tolist() for a, b in zip(border, border[1:])]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check_places(rows, capacity):
    """Sequences without gaps or overlaps; their number."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_and_places(spark, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(PROSE.split()) for _ in range(rng.choice([3, 20, 70, 400])))) for i in range(300)]
    got = packing.pack(documents(spark, rows), MODEL, capacity=128, with_ids=True).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {i for i, _ in rows}
    for i, text in rows:
        own = sorted(pieces[i], key=lambda r: r.piece)
        ids = [x for r in own for x in r.ids]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [128 * k for k in range(len(own))]
        assert all(r.length == 128 for r in own[:-1])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    least = -(-sum(r.length for r in got) // 128)
    assert least <= check_places(got, 128) <= 1.03 * least + 1


def test_odd_rows(spark, odd, none):
    got = packing.pack(odd, MODEL).collect()
    check_places(got, packing.CAPACITY)
    assert sum(r.piece == 0 for r in got) == len(ODD)
    assert sum(r.length == 1 for r in got if r.doc_id in (1, 2, 3)) == 3
    assert packing.pack(none, MODEL).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 4096])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 200))}
    moves = packing.plan(counts, capacity)
    used, ranks = {}, {}
    for length, rank, n, first, offset in sorted(moves.tolist(), key=lambda move: move[4]):
        ranks.setdefault(length, []).extend(range(rank, rank + n))
        for s in range(first, first + n):
            assert used.get(s, 0) == offset
            used[s] = offset + length
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert max(used.values()) <= capacity
    # No more sequences than best-fit decreasing, one piece after the other, but for a few.
    gaps = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is not None:
            gaps.remove(fit)
            gaps.append(fit - length)
        else:
            gaps.append(capacity - length)
    assert len(used) <= 1.02 * len(gaps) + 1


def test_number_of_moves_does_not_follow_the_number_of_rows():
    rng = random.Random(0)
    counts = {rng.randint(1, 4096): rng.randint(1, 30) for _ in range(2000)}
    small, large = (len(packing.plan({k: n * f for k, n in counts.items()})) for f in (1, 1000))
    assert large < 2 * small
