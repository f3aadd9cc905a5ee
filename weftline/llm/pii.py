"""Personal data in whole texts: fixed patterns, and secrets found by weak supervision.

The fixed patterns (e-mail, IP address, card and phone number) are leftmost, not
overlapping per kind; matches that fail their check are dropped. Secrets (keys, tokens,
passwords) have no fixed form: candidates are tokens of letters and digits, 12 characters or
more without an upper limit, and all values that a name marks (``password: ...``, or after a
space alone what is no word of letters), outside the other spans; a number inside a token at least twice as long does not settle it. Labelers by pattern, word list and context vote on each, or abstain.
Expectation-maximisation over the counts of vote patterns in the whole corpus estimates how
reliable each labeler is; the resulting probabilities train a logistic classifier of the
candidates' features, which makes the final choice. Counts are kept by vote pattern and
feature cell, both of bounded number, so all candidates count and little is gathered.

NULL and empty texts have no spans. Repeated rows are treated alike; an empty table gives
an empty result, and a corpus without candidates a classifier that accepts none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import slices

KINDS = ("email", "ip", "card", "phone", "secret")

Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# Starting inside a run of digits finds nothing that its beginning does not find.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= len(m.group()) <= 40:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_TOKEN = re.compile(r"(?<![A-Za-z0-9_/+=.-])[A-Za-z0-9_/+=.-]{12,}+")
_FORM = re.compile(r"AKIA[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{16,}|eyJ[\w-]{10,}\.[\w-]+\.[\w-]+")
_PLAIN = re.compile(r"[0-9][0-9./-]*|[A-Za-z]+[-.][0-9.]+|(?:[a-z]+[/.-])+[a-z0-9]+|[A-Z]?[a-z]+[0-9]{1,4}")
_NAMES = re.compile(r"(?:token|passw(?:or)?d|pwd|passphrase|secret|api[_-]?key|key|auth|bearer|credentials?)\W{0,6}$", re.I)
_OTHER = re.compile(r"(?:isbn|order|invoice|article|model|page|version|ref(?:erence)?|no|file|figure|chapter|https?:\S*)\W{0,6}$", re.I)
_URL = re.compile(r"https?:\S*+", re.I)
#: One of these is in every name.
_STEMS = ("token", "passw", "pwd", "passphrase", "secret", "key", "auth", "bearer", "credential")
#: Names with what stands between them and a value: a mark of assignment, or one space.
_NAMED = re.compile(
    r"(?:token|passw(?:or)?d|pwd|passphrase|secret|api[_-]?key|key|auth|bearer|credentials?)[\"'`]?"
    r"(?:\s{0,3}(?P<mark>:=|=>|[=:])\s{0,3}|\s)[\"'`(\[{]?(?=[^\s\"'`<>])",
    re.I,
)
_VALUE = re.compile(r"[^\s\"'`<>]++")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*+")
_HEX = re.compile(r"[0-9a-f]+")


class Candidate(NamedTuple):
    start: int
    end: int
    votes: tuple[int, ...]  # 1 secret, 0 none, -1 abstains
    cell: tuple[int, ...]


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _places(text: str) -> list[tuple[int, int]]:
    """Where candidates may be: long tokens with a letter and a digit, and values that a name marks."""
    out = {}
    if _DIGIT.search(text):
        for m in _TOKEN.finditer(text):
            # A name before "=" and marks around do not belong to the value.
            head = m.group().rfind("=", 0, len(m.group().rstrip("=")))
            start, end = m.start() + head + 1, m.end()
            while end > start and text[end - 1] in ".-/+":
                end -= 1
            token = text[start:end]
            n_digits = sum(c.isdigit() for c in token)
            if len(token) >= 12 and n_digits and n_digits != sum(c.isalnum() for c in token):
                out[start] = end
    lower, at = text.lower(), 0
    for m in _NAMED.finditer(text) if any(stem in lower for stem in _STEMS) else ():
        if m.end() < at:
            continue
        start, end = m.end(), _VALUE.match(text, m.end()).end()
        at = end
        while end > start and text[end - 1] in ".,;:!?)]}":
            end -= 1
        # After a name and a space, a word is how the sentence goes on.
        if end > start and (m["mark"] or not _WORD.fullmatch(text, start, end)) and text.rfind("=", start, end) + 1 not in out and start not in out:
            out[start] = end
    places: list[tuple[int, int]] = []
    for start, end in sorted(out.items()):
        if not places or start >= places[-1][1]:
            places.append((start, end))
    return places


def candidates(text: str, taken: list[Span]) -> list[Candidate]:
    """Tokens and named values outside ``taken``, their votes and their features."""
    out = []
    near: list[Span] = []
    ahead = 0
    urls = _URL.finditer(text)
    url = next(urls, None)
    for start, end in _places(text):
        token = text[start:end]
        n_digits = sum(c.isdigit() for c in token)
        while ahead < len(taken) and taken[ahead][0] < end:
            near.append(taken[ahead])
            ahead += 1
        near = [span for span in near if span[2] > start]
        if any(not (start <= s and 2 * (e - s) <= end - start >= e - start) for s, _, e in near):
            continue
        while url and url.end() < start:
            url = next(urls, None)
        before = text[max(0, start - 32) : start]
        bits = _entropy(token)
        form, plain = bool(_FORM.fullmatch(token)), bool(_PLAIN.fullmatch(token) or _WORD.fullmatch(token))
        named, other = bool(_NAMES.search(before)), bool(_OTHER.search(before) or (url and url.start() < start < url.end()))
        assigned = before.rstrip("\"'` ").endswith(("=", ":"))
        quoted = text[start - 1 : start] in ('"', "'", "`") and start > 0
        votes = (
            1 if form else -1,
            0 if plain else -1,
            1 if named else -1,
            0 if other else -1,
            1 if assigned or quoted else -1,
            1 if bits >= 3.0 else 0 if bits < 2.5 else -1,
        )
        upper = sum(c.isupper() for c in token) / len(token)
        cell = (
            min(len(token) // 8, 6),
            min(int(4 * n_digits / len(token)), 3),
            min(int(4 * upper), 3),
            min(int(bits), 5),
            int(named),
            int(assigned or quoted),
            int(bool(_HEX.fullmatch(token))),
            int(plain),
        )
        out.append(Candidate(start, end, votes, cell))
    return out


def _features(cells: np.ndarray) -> np.ndarray:
    scale = np.array([6, 3, 3, 5, 1, 1, 1, 1], float)
    return np.concatenate([cells / scale, np.ones((len(cells), 1))], axis=1)


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability of a secret for each vote pattern, by expectation-maximisation.

    Votes are independent given the truth. Counts start from a weak belief that labelers are
    right more often than not, which also decides which class is called a secret.
    """
    said = votes >= 0
    yes = votes == 1
    truth = np.where(said.any(axis=1), (yes.sum(axis=1) + 0.5) / (said.sum(axis=1) + 1), 0.5)
    for _ in range(rounds):
        on, off = truth * n, (1 - truth) * n
        prior = (on.sum() + 1) / (n.sum() + 2)
        logit = np.full(len(n), math.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            # Each labeler says yes, says no, or abstains, with rates per class.
            for answer, (a, b) in ((1, (2.0, 1.0)), (0, (1.0, 2.0)), (-1, (2.0, 2.0))):
                rows = votes[:, j] == answer
                p = (on[rows].sum() + a) / (on.sum() + 5)
                q = (off[rows].sum() + b) / (off.sum() + 5)
                logit[rows] += math.log(p / q)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - truth).max(initial=0) < 1e-6:
            return new
        truth = new
    return truth


def classifier(cells: np.ndarray, n: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier of soft labels, one feature cell per row, with a weak pull to 0."""
    x = _features(cells)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (truth - p)) - w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame) -> np.ndarray | None:
    """Weights of the span classifier, from all candidates of ``docs`` (``text``); None without any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    if text:
                        found.update((c.votes, c.cell) for c in candidates(text, base_spans(text)))
        if found:
            yield pa.record_batch(
                {
                    "votes": pa.array([list(v) for v, _ in found], pa.list_(pa.int32())),
                    "cell": pa.array([list(c) for _, c in found], pa.list_(pa.int32())),
                    "n": pa.array(list(found.values()), pa.int64()),
                }
            )

    counted = docs.select("text").mapInArrow(count, "votes array<int>, cell array<int>, n long")
    rows = counted.groupBy("votes", "cell").agg(F.sum("n").alias("n")).orderBy("votes", "cell").collect()
    if not rows:
        return None
    votes = np.array([r["votes"] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    patterns, of = np.unique(votes, axis=0, return_inverse=True)
    truth = reliabilities(patterns, np.bincount(of.ravel(), n))[of.ravel()]
    return classifier(np.array([r["cell"] for r in rows]), n, truth)


def all_spans(text: str, weights: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """The spans of the fixed patterns, and all spans, by start and kind."""
    base = base_spans(text)
    more = candidates(text, base) if weights is not None else []
    if not more:
        return base, base
    chosen = _features(np.array([c.cell for c in more])) @ weights >= 0
    secrets = [(c.start, 4, c.end) for c, yes in zip(more, chosen) if yes]
    return base, sorted(base + secrets)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): counts per fixed kind, ``base_sha256``, ``spans``, ``n_secret``."""
    names = [f"n_{kind}" for kind in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [all_spans(text or "", weights) for text in part.column("text").to_pylist()]
                out = {"doc_id": part.column("doc_id")}
                for kind, name in enumerate(names):
                    out[name] = pa.array([sum(s[1] == kind for s in spans) for _, spans in found], pa.int64())
                out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
                out["spans"] = pa.array([written(spans) for _, spans in found], pa.string())
                yield pa.record_batch(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{name} long" for name in names)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out.append(text[at:start] + f"<{KINDS[kind]}>")
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """``docs`` with masked texts; all other columns as they are, NULL texts stay NULL."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(text).to_pylist()
                new = [t and masked(t, all_spans(t, weights)[1]) for t in texts]
                yield part.set_column(text, "text", pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
