import random
import re

import numpy as np
import pyarrow as pa

from weftline.llm.words import Texts, slices, window_hash

ALPHABET = ["a", "B", "é", " ", "\n", "\t", "\x0b", " ", "😀", "word"]


def random_texts(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 20))) for _ in range(n)]
    return [None if rng.random() < 0.1 else t for t in texts]


def test_words_are_those_of_the_pattern():
    for seed in range(50):
        texts = random_texts(6, seed)
        found = Texts(pa.array(texts, pa.string()))
        got = [
            [found.bytes[a:b].tobytes().decode() for a, b in zip(found.start[x:y], found.end[x:y])]
            for x, y in zip(found.first, found.first[1:])
        ]
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_are():
    texts = Texts(pa.array(["ab cd", None, "x ab", "cd"]), lower=False)
    h = texts.word_hash()
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    folded = Texts(pa.array(["Ab aB É é"]), lower=True).word_hash()
    assert folded[0] == folded[1] and folded[2] != folded[3]


def test_sliced_arrays_and_windows():
    column = pa.array(["zz", "a b c a b", ""]).slice(1)
    texts = Texts(column)
    assert len(texts) == 2 and len(texts.start) == 5
    grams = window_hash(texts.word_hash(), 2)
    assert grams[0] == grams[3] and len(set(grams.tolist())) == 3
    assert len(window_hash(texts.word_hash(), 6)) == 0


def test_slices_cover_all_rows():
    batch = pa.record_batch({"text": pa.array(["x" * n for n in (0, 50, 5, 0, 200, 1)])})
    parts = list(slices(batch, "text", 60))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1
    assert np.sum([p.num_rows for p in parts]) == 6
