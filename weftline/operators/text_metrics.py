"""Text quality: perplexity, BLEU, ROUGE, weighted F1."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import words
from ..session import cut_lineage
from .vocabulary import count_words, int32_offsets, word_slices


def perplexity(df: DataFrame, loss: str, batch: str | None = None, mode: str = "macro") -> DataFrame:
    """``exp`` of the mean loss: of batch means (``macro``) or of all rows (``micro``)."""
    if mode == "micro":
        mean = df.agg(F.avg(loss).alias("_m"))
    elif mode == "macro":
        mean = df.groupBy(batch).agg(F.avg(loss).alias("_b")).agg(F.avg("_b").alias("_m"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return mean.select(F.lit(mode).alias("mode"), F.exp("_m").alias("perplexity"))


#: The most frequent words, of at most so many bytes each, go to every task; less than 64 MB in all.
KNOWN_ROWS, KNOWN_BYTES = 200_000, 256


def unigram_perplexity(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, under an add-one unigram model fitted on the whole corpus.

    The losses of the most frequent words are summed where the text is. Only the other words, none of
    which is frequent unless it is long, are shuffled to find their counts.
    """
    counts = cut_lineage(count_words(df, text), "counts")
    totals = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).first()
    size = float((totals["n"] or 0) + totals["v"])
    short = counts.where(F.octet_length("token") <= KNOWN_BYTES)
    top = short.orderBy(F.desc("count"), "token").limit(KNOWN_ROWS).toArrow()
    losses = -np.log((top["count"].to_numpy() + 1) / size)
    known = df.sparkSession.sparkContext.broadcast((top["token"].combine_chunks(), losses))

    @F.arrow_udf("array<struct<token string, n bigint, loss double>>")
    def counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            for part in word_slices(column, SLICE_BYTES):
                yield _known_and_rest(part, *known.value)

    # An inner inline would also be turned into a filter on its size, which runs all of it twice.
    rows = df.select(key, F.inline_outer(counted(words(text)))).where(F.col("n").isNotNull())
    # Rows of known words find no count, and must not meet in one partition.
    by = F.coalesce("token", F.concat(F.lit(" "), F.xxhash64(key).cast("string")))
    found = rows.withColumn("_by", by).join(counts.select(F.col("token").alias("_by"), "count"), "_by", "left")
    loss = F.coalesce(-F.log((F.col("count") + 1) / F.lit(size)), F.col("loss"))
    return (
        found.groupBy(key)
        .agg(F.sum("n").alias("n_words"), F.sum(loss).alias("_loss"))
        .select(key, "n_words", F.exp(F.col("_loss") / F.col("n_words")).alias("perplexity"))
    )


def _known_and_rest(part: pa.Array, tokens: pa.Array, losses: np.ndarray) -> pa.Array:
    """Of each row with words, one entry with number and loss of its known words, then an entry for each other word."""
    flat, n_rows = part.flatten(), len(part)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(part), 0))
    row = np.repeat(np.arange(n_rows), sizes)
    at = pc.index_in(flat, value_set=tokens)
    there = np.asarray(at.is_valid())
    kept = np.asarray(at.drop_null())
    n = np.bincount(row[there], minlength=n_rows)
    loss = np.bincount(row[there], losses[kept], n_rows)
    rest = flat.filter(pa.array(~there))
    some = sizes > 0
    ends = np.concatenate([[0], np.cumsum(sizes - n + some, dtype=np.int64)])
    first = np.zeros(ends[-1], dtype=bool)
    first[ends[:-1][some]] = True
    numbers, sums = np.ones(len(first), np.int64), np.zeros(len(first))
    numbers[first], sums[first] = n[some], loss[some]
    words_of = rest.take(pa.array(np.cumsum(~first) - 1, mask=first))
    entries = pa.StructArray.from_arrays([words_of, pa.array(numbers), pa.array(sums)], ["token", "n", "loss"])
    return pa.ListArray.from_arrays(pa.array(int32_offsets(ends)), entries)


#: Text counted at once, at least one pair; the arrays of a pass take about thirty times as much.
SLICE_BYTES = 4 << 20


def _joined(tokens: Column) -> Column:
    """Words as one string: a word holds neither a space nor a line end."""
    return F.array_join(tokens, " ")


def _segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in a row, and the number of the text each one is in."""
    lists = pc.split_pattern(texts, " ")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    flat = lists.flatten()
    # An empty text is split into one empty word.
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), owner[some.to_numpy(zero_copy_only=False)]


def _row_sums(rows: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(rows, values, n_rows).astype(np.int64)


def overlaps(hyps: pa.Array, refs: pa.Array, ns: Sequence[int]) -> np.ndarray:
    """``[n, both, h, r]`` for each n of each pair, behind ``[0, words of hyp, words of the nearest ref, 0]``.

    ``hyps`` has words joined by a space, ``refs`` such texts joined by a line end. Words and
    n-grams of the whole batch are numbered, not hashed: an n-gram is the pair of the
    (n-1)-gram at its start and its last word. Counts are sorted runs of (text, n-gram).
    """
    n_rows, ns = len(hyps), list(ns)
    out = np.zeros((n_rows, len(ns) + 1, 4), np.int64)
    if not n_rows:
        return out
    hyps, refs = (pc.fill_null(c.cast(pa.large_string()), "") for c in (hyps, refs))
    lines = pc.split_pattern(refs, "\n")
    own, own_text = _segments(hyps)
    theirs, their_text = _segments(lines.flatten())
    # Texts 0 to n_rows - 1 are the hypotheses, all others references.
    row = np.concatenate([np.arange(n_rows), np.repeat(np.arange(n_rows), pc.list_value_length(lines).to_numpy())])
    text = np.concatenate([own_text, their_text + n_rows])
    coded = pa.concat_arrays([own, theirs]).dictionary_encode()
    codes, n_words = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))

    length = np.bincount(text, minlength=len(row))
    out[:, 0, 1] = length[:n_rows]
    order = np.lexsort((length[n_rows:], np.abs(length[n_rows:] - length[row[n_rows:]]), row[n_rows:]))
    nearest = order[np.searchsorted(row[n_rows:], np.arange(n_rows))]
    out[:, 0, 2] = length[n_rows:][nearest]

    at, grams = np.arange(len(text)), codes
    for n in range(1, max(ns) + 1):
        if n > 1:
            inside = at + n - 1 < len(text)
            inside[inside] = text[at[inside] + n - 1] == text[at[inside]]
            at = at[inside]
            grams = np.unique(grams[inside] * n_words + codes[at + n - 1], return_inverse=True)[1]
        if n not in ns:
            continue
        i = ns.index(n) + 1
        out[:, i, 0] = n
        if not len(at):
            continue
        width = int(grams.max()) + 1
        keys, counts = np.unique(text[at] * width + grams, return_counts=True)
        of = keys // width
        pair = row[of] * width + keys % width
        mine = of < n_rows
        out[:, i, 2] = _row_sums(row[of[mine]], counts[mine], n_rows)
        out[:, i, 3] = _row_sums(row[of[~mine]], counts[~mine], n_rows)
        if mine.all() or not mine.any():
            continue
        most, inverse = np.unique(pair[~mine], return_inverse=True)
        best = np.zeros(len(most), np.int64)
        np.maximum.at(best, inverse, counts[~mine])
        spot = np.minimum(np.searchsorted(most, pair[mine]), len(most) - 1)
        clipped = np.where(most[spot] == pair[mine], np.minimum(best[spot], counts[mine]), 0)
        out[:, i, 1] = _row_sums(row[of[mine]], clipped, n_rows)
    return out


def _overlap(hyp: Column, refs: Column, ns: Sequence[int]) -> Column:
    """What ``overlaps`` gives for one pair of a text and its references.

    ``both`` counts the n-grams of the hypothesis, each at most as often as it occurs
    in one reference; ``h`` and ``r`` are the n-grams of the hypothesis and of all
    references. A pair is one row, so it is counted where it is: n-grams as rows
    would move several times the text. NULL counts as an empty text.
    """
    ns = list(ns)

    @F.arrow_udf("array<array<bigint>>")
    def count(hyps: pa.Array, references: pa.Array) -> pa.Array:
        sizes = [pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64) for c in (hyps, references)]
        part = np.cumsum(sizes[0] + sizes[1]) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(hyps)]
        found = [overlaps(hyps.slice(a, b - a), references.slice(a, b - a), ns) for a, b in zip(cuts, cuts[1:])]
        values = np.concatenate(found)
        inner = pa.ListArray.from_arrays(np.arange(0, values.size + 1, 4, dtype=np.int32), pa.array(values.ravel()))
        return pa.ListArray.from_arrays(np.arange(0, len(inner) + 1, len(ns) + 1, dtype=np.int32), inner)

    lines = F.array_join(F.transform(refs, lambda t: _joined(words(t))), "\n")
    return count(_joined(words(hyp)), lines)


def _row(n: Column, both: Column, h: Column, r: Column) -> Column:
    return F.struct(n.alias("n"), both.alias("both"), h.alias("h"), r.alias("r"))


def _overlap_rows(pairs: DataFrame, key: str, hyp: Column, refs: Column, ns: Sequence[int]) -> DataFrame:
    """The rows of ``overlaps``; the one of n = 0 has the lengths."""
    counted = pairs.select(key, _overlap(hyp, refs, ns).alias("_c"))
    return counted.select(
        key, F.inline(F.transform("_c", lambda c: _row(c[0].cast("int"), c[1], c[2], c[3])))
    )


def corpus_bleu(
    pairs: DataFrame, key: str = "id", hyp: str = "hyp", refs: str = "refs", max_n: int = 4
) -> DataFrame:
    """One row: pooled clipped precisions, brevity penalty and BLEU.

    The reference length of a pair is the one closest to the hypothesis, the shorter
    of two equally close ones. BLEU is 0 when a precision is 0.
    """
    ns = range(1, max_n + 1)
    n = F.col("n")

    def total(column: str, of: int) -> Column:
        return F.coalesce(F.sum(F.when(n == of, F.col(column)).otherwise(0)), F.lit(0))

    both = _overlap_rows(pairs, key, F.col(hyp), F.col(refs), ns).agg(
        *[total("both", i).alias(f"matched_{i}") for i in ns],
        *[total("h", i).alias(f"total_{i}") for i in ns],
        total("both", 0).alias("hyp_len"),
        total("h", 0).alias("ref_len"),
        F.count_if(n == 0).alias("n_pairs"),
    )
    logs = None
    nonzero = F.lit(True)
    for n in ns:
        nonzero = nonzero & (F.col(f"matched_{n}") > 0)
        part = F.log(F.col(f"matched_{n}") / F.col(f"total_{n}"))
        logs = part if logs is None else logs + part
    penalty = F.when(F.col("hyp_len") >= F.col("ref_len"), F.lit(1.0)).when(
        F.col("hyp_len") > 0, F.exp(1 - F.col("ref_len") / F.col("hyp_len"))
    ).otherwise(F.lit(0.0))
    return both.withColumn("brevity_penalty", penalty).withColumn(
        "bleu",
        F.when(nonzero, F.col("brevity_penalty") * F.exp(logs / F.lit(float(max_n)))).otherwise(F.lit(0.0)),
    )


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def rouge_n(
    pairs: DataFrame, key: str = "id", hyp: str = "hyp", ref: str = "ref", ns: Sequence[int] = (1, 2)
) -> DataFrame:
    """``key, n, recall, precision, f1`` by counted n-gram overlap."""
    counts = _overlap_rows(pairs, key, F.col(hyp), F.array(ref), ns).where("n > 0")
    recall = F.when(F.col("r") > 0, F.col("both") / F.col("r")).otherwise(0.0)
    precision = F.when(F.col("h") > 0, F.col("both") / F.col("h")).otherwise(0.0)
    scores = counts.select(key, "n", recall.alias("recall"), precision.alias("precision"))
    return scores.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def rouge_l(pairs: DataFrame, key: str = "id", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """``key, lcs, recall, precision, f1`` by longest common subsequence of words."""

    @F.pandas_udf("bigint")
    def common(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(a, b):
            # One bit per word of ``a``; a cleared bit is a word of the subsequence.
            a, where = a.split(), {}
            for i, word in enumerate(a):
                where[word] = where.get(word, 0) | 1 << i
            every = (1 << len(a)) - 1
            free = every
            for word in b.split():
                hit = free & where.get(word, 0)
                free = ((free + hit) | (free - hit)) & every
            return len(a) - free.bit_count()

        return pd.Series([one(a, b) for a, b in zip(left, right)])

    sized = pairs.select(key, words(hyp).alias("_h"), words(ref).alias("_r")).withColumn(
        "lcs", common(_joined(F.col("_h")), _joined(F.col("_r")))
    )
    recall = F.when(F.size("_r") > 0, F.col("lcs") / F.size("_r")).otherwise(0.0)
    precision = F.when(F.size("_h") > 0, F.col("lcs") / F.size("_h")).otherwise(0.0)
    scored = sized.select(key, "lcs", recall.alias("recall"), precision.alias("precision"))
    return scored.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def mean_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Averages over pairs."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        *[F.avg(c).alias(c) for c in ("recall", "precision", "f1")],
    )


def weighted_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: F1 per class, averaged by the class's share of the truth."""
    cells = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("_n"))
    sides = cells.select(
        "_n",
        F.inline(
            F.array(
                F.struct(F.col(truth).alias("label"), F.lit(1).alias("is_truth")),
                F.struct(F.col(pred).alias("label"), F.lit(0).alias("is_truth")),
            )
        ),
        (F.col(truth) == F.col(pred)).alias("_hit"),
    )
    classes = sides.groupBy("label").agg(
        F.sum(F.when(F.col("is_truth") == 1, F.col("_n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("is_truth") == 0, F.col("_n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("is_truth") == 1) & F.col("_hit"), F.col("_n")).otherwise(0)).alias("tp"),
    )
    f1 = F.col("tp") * 2.0 / (F.col("support") + F.col("predicted"))
    return classes.agg(
        F.sum("support").alias("n"),
        F.count_if(F.col("support") > 0).alias("n_classes"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )
