"""Language identification by interpolated Kneser-Ney character models.

A text is its runs of letters, in lower case; each run is framed by a boundary symbol, and
characters become symbols of six bits (a-z each their own, all others by code point). Per
language, counts of four symbols over all training texts give a model of order four with
one discount per order. So a language has at most ``2 ** 24`` n-grams of the highest order,
however large the corpus is; that bounds what is gathered and broadcast. A model is
stored as sorted hashes of its n-grams with log probability and back-off weight.

The language with the lowest cross-entropy per symbol is chosen. ``score`` is the
probability that the choice is right, by a logistic curve over the margin to the second
language; ``rejected`` marks texts whose cross-entropy lies far above that of the
language's training texts. Both are fitted to sums over all training texts.

NULL texts and texts without a letter are ``und`` with score 0, as are all texts if there is
nothing to learn from. Rows without ``doc_id`` are never learned from. Repeated rows are
predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .words import Texts, mix, slices

ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
SLICE_BYTES = 4 << 20
#: A text is rejected if its cross-entropy is so many standard deviations above the mean.
REJECT_SIGMAS = 6.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


class Model(NamedTuple):
    lang: str
    keys: np.ndarray  # sorted hashes of n-grams of all orders
    log_prob: np.ndarray
    back_off: np.ndarray


def _key(order: int, code: np.ndarray) -> np.ndarray:
    return mix(code.astype(np.uint64) | np.uint64(order << 32))


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of four symbols for every prediction in the words, and the border of each word."""
    frame = "\0" * (ORDER - 1)
    points = np.frombuffer("".join([frame + w + "\0" for w in words]).encode("utf-32-le"), np.uint32)
    small = (points >= ord("a")) & (points <= ord("z"))
    code = np.where(small, points - ord("a") + 1, np.where(points == 0, 0, 27 + points % 37)).astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    border = np.append(0, np.cumsum(lengths + 1))
    first = np.cumsum(lengths + ORDER) - (lengths + ORDER)
    at = np.repeat(first + ORDER - 1 - border[:-1], lengths + 1) + np.arange(border[-1])
    gram = np.zeros(len(at), np.int64)
    for i in range(ORDER):
        gram = gram << BITS | code[at - (ORDER - 1) + i]
    return gram, border


class Runs:
    """The runs of letters of a slice of texts: distinct ones, and which stands where."""

    def __init__(self, column: pa.Array):
        folded = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
        self.texts = Texts(folded, of_word=_LETTER)
        _, first, self.inverse, self.count = np.unique(
            self.texts.word_hash(), return_index=True, return_inverse=True, return_counts=True
        )
        data = self.texts.bytes.tobytes()
        spans = zip(self.texts.start[first].tolist(), self.texts.end[first].tolist())
        self.words = [data[a:b].decode("utf-8", "replace") for a, b in spans]


def counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n``: how often each code of four symbols occurs in a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            codes = batch.column("lang").dictionary_encode()
            for i, name in enumerate(codes.dictionary.to_pylist()):
                own = batch.filter(pc.equal(codes.indices, i))
                for part in slices(own, "text", SLICE_BYTES):
                    runs = Runs(part.column("text"))
                    gram, border = symbols(runs.words)
                    weight = np.repeat(runs.count, np.diff(border))
                    grams, n = held.get(name, (np.empty(0, np.int64), np.empty(0, np.int64)))
                    found, where = np.unique(np.concatenate([grams, gram]), return_inverse=True)
                    held[name] = found, np.bincount(where, np.concatenate([n, weight])).astype(np.int64)
        for name, (grams, n) in held.items():
            yield pa.record_batch({"lang": pa.array([name] * len(grams)), "gram": grams, "n": n})

    found = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def model(lang: str, gram: np.ndarray, n: np.ndarray) -> Model:
    """The interpolated Kneser-Ney model of one language."""
    tables = {ORDER: (gram, n.astype(float))}
    for order in range(ORDER - 1, 0, -1):
        # How many different symbols stand before each shorter n-gram.
        tail = tables[order + 1][0] & ((1 << BITS * order) - 1)
        grams, left = np.unique(tail, return_counts=True)
        tables[order] = grams, left.astype(float)
    below_grams, below = np.zeros(1, np.int64), np.array([1.0 / SYMBOLS])
    keys, probs, weights = [], [], []
    back: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for order in range(1, ORDER + 1):
        grams, c = tables[order]
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.5
        context, of = np.unique(grams >> BITS, return_inverse=True)
        total = np.bincount(of, c)
        spare = discount * np.bincount(of) / total
        suffix = grams & ((1 << BITS * (order - 1)) - 1)
        lower = below[np.searchsorted(below_grams, suffix)] if order > 1 else below[0]
        prob = np.maximum(c - discount, 0) / total[of] + spare[of] * lower
        back[order - 1] = context, np.log2(spare)
        keys.append(_key(order, grams))
        probs.append(np.log2(prob))
        below_grams, below = grams, prob
    for order in range(1, ORDER + 1):
        grams = tables[order][0]
        context, spare = back.get(order, (np.empty(0, np.int64), np.empty(0)))
        weight = np.zeros(len(grams))
        if len(context):
            at = np.minimum(np.searchsorted(context, grams), len(context) - 1)
            weight = np.where(context[at] == grams, spare[at], 0.0)
            # A context of boundary symbols alone is never predicted itself.
            extra = np.setdiff1d(context, grams)
            keys.append(_key(order, extra))
            probs.append(np.full(len(extra), np.nan))
            weights.append((weight, spare[np.searchsorted(context, extra)]))
        else:
            weights.append((weight, np.empty(0)))
    empty = back[0][1][0] if len(back[0][1]) else 0.0
    all_keys = np.concatenate([*keys, _key(0, np.zeros(1, np.int64))])
    all_probs = np.concatenate([*probs, [-float(BITS)]])
    all_weights = np.concatenate([*(w for w, _ in weights), *(e for _, e in weights), [empty]])
    order = np.argsort(all_keys)
    return Model(lang, all_keys[order], all_probs[order].astype(np.float32), all_weights[order].astype(np.float32))


def log_probs(m: Model, gram: np.ndarray) -> np.ndarray:
    """Log probability (base 2) of the last symbol of each code after the three before it."""
    out = np.zeros(len(gram))
    open_ = np.arange(len(gram))
    for order in range(ORDER, -1, -1):
        code = gram[open_] & ((1 << BITS * order) - 1)
        at = np.minimum(np.searchsorted(m.keys, key := _key(order, code)), len(m.keys) - 1)
        prob = m.log_prob[at]
        found = (m.keys[at] == key) & ~np.isnan(prob)
        out[open_[found]] += prob[found]
        open_ = open_[~found]
        if not len(open_) or order == 0:
            return out
        context = (gram[open_] & ((1 << BITS * order) - 1)) >> BITS
        at = np.minimum(np.searchsorted(m.keys, key := _key(order - 1, context)), len(m.keys) - 1)
        out[open_] += np.where(m.keys[at] == key, m.back_off[at], 0.0)
    return out


def entropies(models: list[Model], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text and model the cross-entropy in bits per symbol (NaN without letters); symbols per text."""
    runs = Runs(column)
    gram, border = symbols(runs.words)
    first = runs.texts.first
    length = np.diff(border)[runs.inverse] if len(runs.words) else np.empty(0, np.int64)
    n = np.append(0, np.cumsum(length))
    n = n[first[1:]] - n[first[:-1]]
    out = np.empty((len(runs.texts), len(models)))
    with np.errstate(invalid="ignore", divide="ignore"):
        for i, m in enumerate(models):
            total = np.append(0.0, np.cumsum(log_probs(m, gram)))
            word = (total[border[1:]] - total[border[:-1]])[runs.inverse]
            running = np.append(0.0, np.cumsum(word))
            out[:, i] = -(running[first[1:]] - running[first[:-1]]) / n
    return out, n


def remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def train(docs: DataFrame) -> list[Model]:
    """One model for each language of ``docs`` (``lang`` not NULL, ``text``)."""
    gathered: dict[str, list] = {}
    for r in counts(docs).toArrow().to_batches():
        names = r.column("lang").dictionary_encode()
        for i, name in enumerate(names.dictionary.to_pylist()):
            own = r.filter(pc.equal(names.indices, i))
            gathered.setdefault(name, []).append((own.column("gram").to_numpy(), own.column("n").to_numpy()))
    out = []
    for name in sorted(gathered):
        gram, n = (np.concatenate(c) for c in zip(*gathered[name]))
        order = np.argsort(gram)
        out.append(model(name, gram[order], n[order]))
    return out


def _scored(docs: DataFrame, models: list[Model]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                column = part.column("text")
                bits, n = entropies(models, column)
                letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                letter &= n > 0
                ranked = np.argsort(np.where(np.isnan(bits), np.inf, bits), axis=1, kind="stable")
                rows = np.arange(len(bits))
                best = bits[rows, ranked[:, 0]]
                second = bits[rows, ranked[:, min(1, len(models) - 1)]]
                names = np.array([m.lang for m in models], dtype=object)[ranked[:, 0]]
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "lang": part.column("lang"),
                        "learned": part.column("learned"),
                        "lang_pred": pa.array(names, pa.string(), mask=~letter),
                        "bits": pa.array(best, mask=~letter),
                        "margin": pa.array(second - best, mask=~letter),
                        "n_symbols": n,
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, lang string, learned boolean, lang_pred string, bits double, margin double, n_symbols long"
    )


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept from (evidence, texts, right ones), with a weak pull to slope 1, intercept 0."""
    x = np.array([r[0] for r in rows], float)
    n = np.array([r[1] for r in rows], float)
    y = np.array([r[2] for r in rows], float)
    w, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    features = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (y - n * p) - (w - prior)
        curve = (features * (n * p * (1 - p))[:, None]).T @ features + np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """Per row: ``doc_id``, ``lang_pred``, ``score``, ``bits`` per symbol, ``margin``, ``rejected``.

    ``docs`` has ``doc_id``, ``text`` and ``lang``. Rows where ``learn`` holds and ``lang`` is
    known train the models; ``lang`` is used for nothing else.
    """
    rows = docs.select("doc_id", "text", "lang", F.coalesce(learn & F.col("lang").isNotNull(), F.lit(False)).alias("learned"))
    models = train(rows.where("learned"))
    if not models:
        none = F.lit(None).cast("double")
        return rows.select(
            "doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("bits"), none.alias("margin"), F.lit(False).alias("rejected")
        )
    scored = cut_lineage(_scored(rows, models), "languages")
    # Evidence grows with the margin and the length of the text; short steps, few rows.
    grown = F.col("margin") * F.sqrt(F.col("n_symbols").cast("double"))
    evidence = F.when(grown.isNotNull(), F.least(grown, F.lit(20.0)))
    known = scored.where("learned and lang_pred is not null")
    steps = known.groupBy(F.round(evidence, 1).alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("long")).alias("y")
    )
    slope, intercept = _logistic([(r["x"], r["n"], r["y"]) for r in steps.collect()])
    limits = known.where("lang = lang_pred").groupBy("lang_pred").agg(
        (F.avg("bits") + REJECT_SIGMAS * F.coalesce(F.stddev_samp("bits"), F.lit(0.0))).alias("_limit")
    )
    out = scored.join(F.broadcast(limits), "lang_pred", "left")
    score = 1 / (1 + F.exp(-(slope * evidence + intercept)))
    return out.select(
        "doc_id",
        F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
        "bits",
        "margin",
        F.coalesce(F.col("bits") > F.col("_limit"), F.lit(False)).alias("rejected"),
    )
