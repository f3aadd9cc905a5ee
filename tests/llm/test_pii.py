import hashlib
import random
import re

import numpy as np
import pytest

from llm.conftest import ODD, documents
from weftline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_NUMBER = "4556737586899855"


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    alphabet = ["a", "b.", "@", ".", "com", "x@y.org", "_", "1", "25", "255", "256", "000", "+", "+1", "(", "-", " ", CARD_NUMBER, "é", "00", "٣", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "+1" * 100_000, "1." * 150_000, "9 " * 200_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)


def hexed(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def secrets(rng, i):
    return rng.choice([f'token = "{hexed(rng, 40)}"', f"password={hexed(rng, 18)}", "key AKIA" + "".join(rng.choice("ABCDEFGHJK234567") for _ in range(16))])


def corpus(seed=1):
    rng = random.Random(seed)
    words = "some words of plain prose that hold nothing private at all".split()
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(30))
        if i % 10 == 0:
            text += " " + secrets(rng, i) + " and on"
        elif i % 10 == 1:
            text += rng.choice([" see chapter-2024-12-31 now", " page1234567890 of it", " model-10.12.2024 is out", " order 2024-01-02-0001"])
        rows.append((i, text))
    return rows


def test_secrets_are_found_and_plain_texts_left_alone(spark):
    rows = corpus()
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in pii.find(docs, pii.train(docs)).collect()}
    assert all(got[i].n_secret == 1 for i in range(0, 300, 10))
    assert all(got[i].spans == "" for i in range(300) if i % 10)
    text = rows[0][1]
    (kind, start, end), = [s.split(":") for s in got[0].spans.split(",")]
    assert kind == "secret" and re.fullmatch(r"[0-9a-f]{18}|[0-9a-f]{40}|AKIA\w{16}", text[int(start) : int(end)])


def test_training_does_not_depend_on_partitions(spark):
    docs = documents(spark, corpus())
    assert np.allclose(pii.train(docs), pii.train(docs.repartition(7)))


def test_em_finds_reliable_labelers():
    # Labeler 0 is right, 1 votes at random, 2 is right but mostly silent.
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    votes = np.stack(
        [
            np.where(rng.random(20_000) < 0.95, truth, ~truth).astype(int),
            rng.integers(0, 2, 20_000),
            np.where(rng.random(20_000) < 0.3, truth.astype(int), -1),
        ],
        axis=1,
    )
    patterns, of, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = pii.reliabilities(patterns, n.astype(float))[of.ravel()]
    assert ((p > 0.5) == truth).mean() > 0.94


def test_odd_rows(spark, odd, none):
    got = pii.find(odd, pii.train(odd)).collect()
    assert len(got) == len(ODD)
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got if r.doc_id in (1, 2, 3))
    assert pii.train(none) is None and pii.find(none, None).count() == 0
    masked = pii.redact(odd, None)
    assert masked.columns == odd.columns and masked.count() == len(ODD)
    assert sum(r.text is None for r in masked.select("text").collect()) == 2


def test_result_and_masks(spark):
    text = f"é mail a.b@c.org, call +1 (314) 555-4198 or pay {CARD_NUMBER} from 10.0.0.1"
    row = pii.find(documents(spark, [(1, text)]), None).first()
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute(text))
    assert row.spans == base and row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert pii.masked(text, brute(text)) == "é mail <email>, call <phone> or pay <card> from <ip>"
    assert pii.masked("abcdef", [(1, 0, 4), (2, 2, 5)]) == "a<email>f"


def found(text):
    return [text[c.start : c.end] for c in pii.candidates(text, pii.base_spans(text))]


def test_tokens_of_any_length_and_named_values_are_candidates():
    rng = random.Random(3)
    signed = ".".join(("eyJ" + hexed(rng, 300), hexed(rng, 700), hexed(rng, 300)))
    assert found(f"see {signed} there") == [signed]
    key = hexed(rng, 2000) + CARD_NUMBER + "f" + hexed(rng, 2000)
    assert found(f"key={key}") == [key]
    for text, value in (("password: hunter2.", "hunter2"), ("PWD=swordfish", "swordfish"), ("'secret': 'Tr0ub4dor&3'", "Tr0ub4dor&3"), ("Bearer abc123", "abc123")):
        assert found(text) == [value]
    for text in ("the key idea of a secret garden", "password:", f"card key: {CARD_NUMBER}", "token: a@b.org"):
        assert found(text) == []


def test_a_long_token_is_masked(spark):
    rng = random.Random(4)
    signed = ".".join(("eyJ" + hexed(rng, 300), hexed(rng, 700), hexed(rng, 300)))
    rows = [*corpus(), (1000, f"token = {signed} and on"), (1001, "password: hunter2secret99 and on")]
    weights = pii.train(documents(spark, corpus()))
    got = {r.doc_id: r.text for r in pii.redact(documents(spark, rows), weights).collect()}
    assert got[1000] == "token = <secret> and on" and got[1001] == "password: <secret> and on"


@pytest.mark.parametrize("text", ["key=" * 50_000 + "1", "key: " * 50_000, "a1" * 150_000, "a." * 150_000 + "1", "key 1.2.3.4 " * 20_000])
def test_candidates_of_long_runs_take_linear_time(text):
    pii.candidates(text, pii.base_spans(text))


def test_a_url_of_any_length_is_seen_before_a_token():
    rng = random.Random(5)
    text = f"see https://example.org/{'path/' * 20}?session&x={hexed(rng, 20)} and {hexed(rng, 20)} there"
    assert [c.votes[3] for c in pii.candidates(text, [])][-2:] == [0, -1]
