"""Quality rules: word counts, repetition, and distance to the languages of the corpus.

A text is judged by two histograms: its characters by class and its words by the common
words of a language (all others are one more bin). Both are compared with the same
histograms of each language of the corpus by the Jensen-Shannon distance (the square root
of the divergence to base 2, from 0 to 1); the closest language counts.

References are made from every row with a language. A language takes part if it has at
least ``min_lang_words`` words, however small its share, or ``lang_share`` of those rows. A word is
common if it is at least ``word_share`` of the language's words: at most ``1 / word_share``
words a language, so the references grow with the number of languages, not with the table,
and are broadcast.

A text that no reference can stand for is not judged by distance and keeps the verdict of its
counts: one whose own language has no reference, or with at least half of its letters
in scripts that are none of a reference's main ones (``script_share`` of its letters).

Rows without words (NULL, empty, separators alone) have zero counts and no distances and
are not kept. Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .words import LEAD, SPACE, Texts, mix, slices, sums, window_hash

CLASSES = ("lower", "upper", "space", "stop", "symbol", "other", "letter")
WINDOW = 8

_CLASS = np.full(256, CLASSES.index("other"))
_CLASS[ord("a") : ord("z") + 1] = CLASSES.index("lower")
_CLASS[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
# Digits count with the stops: a number of many digits is no fault of a text.
_CLASS[ord("0") : ord("9") + 1] = CLASSES.index("stop")
_CLASS[SPACE] = CLASSES.index("space")
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = CLASSES.index("stop")
_CLASS[[ord(c) for c in "#*$%&|<>!@=+^_~`/\\[]{}"]] = CLASSES.index("symbol")
_CLASS[128:] = CLASSES.index("letter")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


#: Text worked on at once; its arrays take about sixty times as much.
BATCH_BYTES = 2 << 20


@dataclass(frozen=True)
class Rules:
    """Parameters. ``min_chars`` and ``min_words`` guard short texts, whose histograms say little."""

    min_words_kept: int = 20
    max_repeat_percent: int = 30
    min_chars: int = 200
    max_class_distance: float = 0.25
    min_words: int = 40
    max_word_distance: float = 0.42
    lang_share: float = 0.01
    min_lang_words: int = 2000
    script_share: float = 0.1
    word_share: float = 0.004


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"{COUNTS}, base_failed boolean, kept boolean, class_distance double, word_distance double, closest_lang string"


def _class_histogram(texts: Texts) -> np.ndarray:
    kind = _CLASS[texts.bytes]
    lead = LEAD[texts.bytes]
    return np.stack([sums((kind == c) & lead, texts.border) for c in range(len(CLASSES))], axis=1)


def _script(points: range) -> str:
    """Script of the first letter among code points, by its name; empty if none is a letter."""
    for point in points:
        if unicodedata.category(chr(point))[0] == "L":
            return unicodedata.name(chr(point), "").split(" ")[0].split("-")[0]
    return ""


@lru_cache(maxsize=1)
def _scripts() -> tuple[list[str], np.ndarray]:
    """Names of scripts, and the number of the script by the first two bytes of a character (0: no letter)."""
    names = {"": 0}
    table = np.zeros(1 << 16, np.int64)

    def put(first: int, second: int, name: str) -> None:
        table[first << 8 | second] = names.setdefault(name, len(names))

    for point in range(128):
        name = _script(range(point, point + 1))
        if name:
            table[point << 8 : (point + 1) << 8] = names.setdefault(name, len(names))
    for bits, first, last, lead in ((0, 0x80, 0x800, 0xC0), (6, 0x800, 0x10000, 0xE0), (12, 0x10000, 0x40000, 0xF0)):
        for start in range(first, last, 1 << bits):
            put(lead | start >> (bits + 6), 0x80 | (start >> bits) & 0x3F, _script(range(start, start + (1 << bits))))
    return list(names), table


def _script_histogram(texts: Texts) -> np.ndarray:
    """Per text, its letters by script."""
    names, table = _scripts()
    n, raw = len(texts), texts.bytes
    lead = np.flatnonzero(LEAD[raw])
    if not len(lead):
        return np.zeros((n, len(names)), np.int64)
    second = raw[np.minimum(lead + 1, len(raw) - 1)].astype(np.int64)
    kind = table[raw[lead].astype(np.int64) << 8 | second]
    owner = np.searchsorted(texts.border, lead, side="right") - 1
    out = np.bincount(owner * len(names) + kind, minlength=n * len(names)).reshape(n, len(names))
    out[:, 0] = 0
    return out


def _repeated_words(texts: Texts, words: np.ndarray) -> np.ndarray:
    """Per text, the words in windows of ``WINDOW`` words that the text has twice or more."""
    grams = window_hash(words, WINDOW)
    if not len(grams):
        return np.zeros(len(texts), np.int64)
    owner = texts.word_text()
    whole = owner[: len(grams)] == owner[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    keys = mix(grams[at] ^ (owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order[twice]]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return sums(np.cumsum(change[:-1]) > 0, texts.first)


def _duplicate_lines(texts: Texts) -> np.ndarray:
    """Per text, lines with a word that are equal to an earlier line of the text."""
    breaks = np.flatnonzero(texts.bytes == 10)
    start = np.union1d(breaks + 1, texts.border[:-1])
    start = start[start < len(texts.bytes)]
    if not len(start):
        return np.zeros(len(texts), np.int64)
    end = np.append(start[1:], len(texts.bytes))
    end = end - (texts.bytes[end - 1] == 10)
    filled = np.searchsorted(texts.start, end) > np.searchsorted(texts.start, start)
    start, end = start[filled], end[filled]
    owner = np.searchsorted(texts.border, start, side="right") - 1
    keys = mix(texts.span_hash(start, end) ^ mix(owner.astype(np.uint64)))
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), np.int64)
    again[first] = 0
    return np.bincount(owner, again, minlength=len(texts)).astype(np.int64)


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to one reference (shares); NaN without counts."""
    total = counts.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / total
        q = np.broadcast_to(reference, p.shape)
        m = (p + q) / 2
        part = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    out = np.sqrt(np.clip(part.sum(axis=1) / 2, 0, 1))
    return np.where(total[:, 0] > 0, out, np.nan)


def references(docs: DataFrame, rules: Rules = Rules()) -> list[dict]:
    """Per language: name, class shares, common words (hashes) and their shares."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull()).select("lang", "text")
    n_classes = len(CLASSES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = Texts(part.column("text"), lower=True)
                codes = part.column("lang").dictionary_encode()
                lang = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                names = codes.dictionary.to_pylist()
                classes = _class_histogram(texts)
                scripts = _script_histogram(texts)
                words = texts.word_hash()
                of_word = lang[texts.word_text()]
                for i, name in enumerate(names):
                    own, n = np.unique(words[of_word == i], return_counts=True)
                    mine = classes[lang == i].sum(axis=0)
                    rows = int((lang == i).sum())
                    written = scripts[lang == i].sum(axis=0)
                    used = np.flatnonzero(written)
                    keys = np.concatenate([np.arange(n_classes + 1), own.astype(np.int64), used])
                    kind = np.repeat([0, 1, 2], [n_classes + 1, len(own), len(used)])
                    values = np.concatenate([mine, [rows], n, written[used]]).astype(np.int64)
                    yield pa.record_batch(
                        {"lang": pa.array([name] * len(keys)), "kind": kind.astype(np.int32), "key": keys, "n": values}
                    )

    counted = known.mapInArrow(count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted, "quality")
    fixed = counted.where("kind = 0").groupBy("lang").pivot("key", list(range(n_classes + 1))).agg(F.sum("n"))
    rows = F.col(str(n_classes))
    every = counted.where(f"kind = 0 and key = {n_classes}").agg(F.sum("n")).first()[0] or 0
    sizes = counted.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    enough = (rows >= math.ceil(rules.lang_share * every)) | (F.col("total") >= rules.min_lang_words)
    large = [r.asDict() for r in fixed.join(sizes, "lang", "left").where(enough).collect()]
    if not large:
        return []
    totals = {r["lang"]: r["total"] for r in large if r["total"]}
    words = counted.where("kind = 1")
    least = spark.createDataFrame([(k, max(1.0, v * rules.word_share)) for k, v in totals.items()] or [("", 1.0)], "lang string, least double")
    common: dict[str, list] = {}
    for r in words.join(F.broadcast(least), "lang").where("n >= least").select("lang", "key", "n").collect():
        common.setdefault(r["lang"], []).append((r["key"], r["n"]))
    written: dict[str, dict[int, int]] = {}
    for r in counted.where("kind = 2").select("lang", "key", "n").collect():
        written.setdefault(r["lang"], {})[r["key"]] = r["n"]
    out = []
    for r in sorted(large, key=lambda r: r["lang"]):
        letters = written.get(r["lang"], {})
        classes = np.array([r[str(i)] or 0 for i in range(n_classes)], float)
        own = sorted(common.get(r["lang"], []))
        total = totals.get(r["lang"], 0)
        shares = np.array([n for _, n in own] + [total - sum(n for _, n in own)], float)
        out.append(
            {
                "lang": r["lang"],
                "classes": classes / max(classes.sum(), 1),
                "words": np.array([k for k, _ in own], np.int64).astype(np.uint64),
                "shares": shares / max(shares.sum(), 1),
                "scripts": [k for k, n in sorted(letters.items()) if n >= rules.script_share * sum(letters.values())],
            }
        )
    return out


def _bins(words: np.ndarray, owner: np.ndarray, n_texts: int, common: np.ndarray) -> np.ndarray:
    order = np.argsort(common)
    width = len(common) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common[order], words), len(common) - 1)
        bin_of = np.where(common[order][at] == words, order[at], len(common))
    else:
        bin_of = np.zeros(len(words), np.int64)
    return np.bincount(owner * width + bin_of, minlength=n_texts * width).reshape(n_texts, width)


def quality(docs: DataFrame, rules: Rules = Rules(), langs: list[dict] | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the counts, ``base_failed``, ``kept`` and the distances.

    ``docs`` has ``doc_id``, ``text`` and, where references are not given, ``lang``. A text
    whose ``base_failed`` is false is kept unless it is farther than a threshold from every language
    though a reference can stand for it.
    """
    langs = references(docs, rules) if langs is None else langs
    shared = docs.sparkSession.sparkContext.broadcast(langs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                lang = part.column("lang") if "lang" in part.schema.names else None
                yield pa.record_batch({"doc_id": part.column("doc_id"), **judged(part.column("text"), shared.value, rules, lang)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    return docs.select(*columns).mapInArrow(judge, f"doc_id {kind}, {SCHEMA}")


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; rows are judged where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(references(docs, rules))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                yield part.filter(pa.array(judged(part.column(text), shared.value, rules, part.column(lang))["kept"]))

    return docs.mapInArrow(run, docs.schema)


def _foreign(texts: Texts, langs: list[dict], own: pa.Array | None) -> np.ndarray:
    """Whether no reference can stand for a text, by its own language or its script."""
    scripts = _script_histogram(texts)
    known = sorted({k for r in langs for k in r["scripts"]})
    letters = scripts.sum(axis=1)
    out = (letters > 0) & (2 * scripts[:, known].sum(axis=1) <= letters)
    if own is not None:
        names = {r["lang"] for r in langs}
        out |= np.array([name is not None and name not in names for name in own.to_pylist()], bool)
    return out


def judged(column: pa.Array, langs: list[dict], rules: Rules, own: pa.Array | None = None) -> dict:
    """The output columns for one slice of texts; ``own`` has their languages as far as known."""
    exact, folded = Texts(column), Texts(column, lower=True)
    n = len(exact)
    n_words = np.diff(exact.first)
    classes = _class_histogram(exact)
    word_chars = classes.sum(axis=1) - classes[:, CLASSES.index("space")]
    repeated = _repeated_words(exact, exact.word_hash())
    failed = (n_words < rules.min_words_kept) | (100 * repeated > rules.max_repeat_percent * n_words)
    class_distance, word_distance = np.full(n, np.nan), np.full(n, np.nan)
    closest = np.full(n, None, dtype=object)
    if langs and n:
        words, owner = folded.word_hash(), folded.word_text()
        by_class = np.stack([distance(classes, r["classes"]) for r in langs])
        by_word = np.stack([distance(_bins(words, owner, n, r["words"]), r["shares"]) for r in langs])
        class_distance = by_class.min(axis=0)
        word_distance = by_word.min(axis=0)
        some = n_words > 0
        best = np.argmin(np.where(np.isnan(by_word), 2, by_word), axis=0)
        closest[some] = np.array([r["lang"] for r in langs], dtype=object)[best[some]]
    far = (classes.sum(axis=1) >= rules.min_chars) & (class_distance > rules.max_class_distance)
    far |= (n_words >= rules.min_words) & (word_distance > rules.max_word_distance)
    if far.any():
        far &= ~_foreign(exact, langs, own)
    none = n_words == 0
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": sums(_SYMBOL[exact.bytes], exact.border),
        "n_dup_lines": _duplicate_lines(exact),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": ~failed & ~far,
        "class_distance": pa.array(class_distance, mask=none | np.isnan(class_distance)),
        "word_distance": pa.array(word_distance, mask=none | np.isnan(word_distance)),
        "closest_lang": pa.array(list(closest), pa.string()),
    }
