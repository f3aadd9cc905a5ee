"""Word tokens, vocabulary, encoding and embedding lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import FIRST_PAYLOAD_ID, PAD, UNK, words
from ..session import cut_lineage
from .lookup import lookup
from .ordering import with_ordinal

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def int32_offsets(offsets: np.ndarray) -> np.ndarray:
    """Offsets of an Arrow list, or an error where 32 bits do not hold them."""
    if len(offsets) and offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("an Arrow batch has more than 2^31 - 1 values; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return offsets.astype(np.int32)


def word_slices(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """Lists of words in slices of ``size`` bytes of words, a row at least."""
    n_words = pc.fill_null(pc.list_value_length(column), 0)
    rows = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(column.flatten()), dtype=np.int64)])[rows]
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield column.slice(first, stop - first)
        first = stop


def tokenize_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: ``key, pos, token``; ``pos`` counts from 0."""
    return df.select(key, F.posexplode(words(text)).alias("pos", "token"))


def word_stats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, last_pos, n_distinct, weight`` of the documents that have words.

    ``weight`` sums the lengths of all words, each times its place. Words are counted where their text
    is; only those of keys that several rows share are brought together, to count the different ones.
    """
    found = df.select(key, words(text).alias("_w"))
    lengths = F.transform("_w", lambda w, i: (i + 1).cast("bigint") * F.length(w))
    per_row = found.select(
        key,
        F.greatest(F.size("_w"), F.lit(0)).alias("_n"),
        F.greatest(F.size(F.array_distinct("_w")), F.lit(0)).cast("bigint").alias("_distinct"),
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("_weight"),
    )
    stats = (
        per_row.groupBy(key)
        .agg(
            F.sum("_n").alias("n_words"),
            (F.max("_n") - 1).alias("last_pos"),
            F.max("_distinct").alias("n_distinct"),
            F.sum("_weight").alias("weight"),
        )
        .where(F.col("n_words") > 0)
    )
    shared = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    shared = cut_lineage(shared.select(F.col(key).alias("_shared")), "shared")
    if shared.isEmpty():
        return stats
    some = df.join(shared, F.col(key).eqNullSafe(F.col("_shared")), "left_semi")
    many = tokenize_words(some, key, text).groupBy(F.col(key).alias("_shared")).agg(F.countDistinct("token").alias("_many"))
    both = stats.join(many, F.col(key).eqNullSafe(F.col("_shared")), "left")
    return both.select(key, "n_words", "last_pos", F.coalesce("_many", "n_distinct").alias("n_distinct"), "weight")


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """``token, count`` over the whole corpus; counted before the shuffle."""
    return (
        df.select(F.explode(words(text)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def build_vocab(counts: DataFrame, max_size: int | None = None, min_count: int = 1) -> DataFrame:
    """``token, count, id``: most frequent first, ties by token, ids from 12."""
    kept = counts.where(F.col("count") >= min_count).withColumn("_rank_by", -F.col("count"))
    if max_size is not None and max_size <= BROADCAST_ROWS:
        top = kept.orderBy("_rank_by", "token").limit(max_size)
        # At most BROADCAST_ROWS rows are left.
        ranked = top.withColumn("_rank", F.row_number().over(Window.orderBy("_rank_by", "token")) - 1)
    else:
        ranked = with_ordinal(cut_lineage(kept, "counts"), ["_rank_by", "token"], "_rank", staged=True)
        if max_size is not None:
            ranked = ranked.where(F.col("_rank") < max_size)
    return ranked.select(
        "token", "count", (F.col("_rank") + FIRST_PAYLOAD_ID).cast("int").alias("id")
    )


def encode_tokens(tokens: DataFrame, vocab: DataFrame, unk: int = UNK) -> DataFrame:
    """Add ``id`` to token rows; any vocabulary size."""
    found = lookup(tokens, vocab.select("token", "count", "id"), "token", "count")
    return found.withColumn("id", F.coalesce("id", F.lit(unk))).drop("count")


def gather_ids(encoded: DataFrame, *keys: str) -> DataFrame:
    """``keys, input_ids``: the ids of each document in order; a place given twice counts once."""
    rows = F.sort_array(F.collect_set(F.struct("pos", "id")))
    return encoded.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.col("_rows.id").alias("input_ids"))


def fits_broadcast(table: DataFrame, size: Column) -> bool:
    """True when the table has few rows and few bytes; decides how to join it."""
    found = table.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    return found["n"] <= BROADCAST_ROWS and (found["bytes"] or 0) <= BROADCAST_BYTES


def encode(
    df: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text", unk: int = UNK
) -> DataFrame:
    """``key, input_ids``: the words of each document as vocabulary ids.

    A vocabulary that passes the size check goes to every task and whole Arrow
    batches are looked up in place, so no token is shuffled. A larger one is joined.
    Both give one row per row of ``df``: a NULL text has NULL ids, one without words
    none, and rows that share a key keep their own ids.
    """
    vocab = cut_lineage(vocab, "vocab")
    if not fits_broadcast(vocab, F.octet_length("token")):
        return _encode_joined(df, vocab, key, text, unk)
    listed = vocab.select("token", "id").toArrow()
    entries = df.sparkSession.sparkContext.broadcast(
        (listed["token"].combine_chunks(), listed["id"].combine_chunks())
    )

    @F.arrow_udf("array<int>")
    def look_up(column: pa.Array) -> pa.Array:
        tokens, ids = entries.value
        found = pc.take(ids, pc.index_in(column.flatten(), value_set=tokens))
        sizes = pc.fill_null(pc.list_value_length(column), 0)
        offsets = int32_offsets(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
        missing = pa.array(np.asarray(column.is_null()))
        ids = pc.fill_null(found, unk).cast(pa.int32())
        return pa.ListArray.from_arrays(pa.array(offsets), ids, mask=missing)

    return df.select(key, look_up(words(text)).alias("input_ids"))


def _encode_joined(df: DataFrame, vocab: DataFrame, key: str, text: str, unk: int) -> DataFrame:
    """``encode`` for any size of vocabulary.

    A row is known by its key and a digest of its text: rows equal in both have equal
    ids, so it does not matter that their words meet.
    """
    rows, tokens = _rows_and_tokens(df, key, text)
    return _given_back(rows, gather_ids(encode_tokens(tokens, vocab, unk), "_key", "_digest"), key)


def _rows_and_tokens(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    rows = df.select(F.col(key).alias("_key"), F.sha2(text, 256).alias("_digest"), F.col(text).alias("_text"))
    tokens = rows.select("_key", "_digest", F.posexplode(words("_text")).alias("pos", "token"))
    return rows.select("_key", "_digest"), tokens


def _given_back(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row of ids for each row; none for a text without words, NULL for a NULL text."""
    found = found.withColumnRenamed("_key", "_found")
    same = rows["_key"].eqNullSafe(found["_found"]) & (rows["_digest"] == found["_digest"])
    none = F.when(rows["_digest"].isNotNull(), F.array().cast("array<int>"))
    return rows.join(found, same, "left").select(
        rows["_key"].alias(key), F.coalesce(found["input_ids"], none).alias("input_ids")
    )


def lookup_embeddings(
    ids: DataFrame,
    table: DataFrame,
    dim: int,
    id_col: str = "id",
    pad_id: int = PAD,
    salts: int = 32,
) -> DataFrame:
    """Add ``vec`` to id rows from ``table`` (``token_id, vec``); padding gives zeros.

    A table that passes the size check is broadcast. Otherwise the table is copied
    ``salts`` times and each id row picks one copy, so that a frequent id spreads
    over ``salts`` tasks.
    """
    table = table.select(F.col("token_id").alias("_token"), "vec")
    if fits_broadcast(table, F.size("vec") * 8):
        joined = ids.join(F.broadcast(table), F.col(id_col) == F.col("_token"), "left")
    else:
        copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = ids.withColumn("_salt", F.pmod(F.xxhash64(*ids.columns), F.lit(salts)).cast("int"))
        joined = salted.join(
            copies, (F.col(id_col) == F.col("_token")) & (F.col("_salt") == F.col("_copy")), "left"
        ).drop("_salt", "_copy")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return joined.withColumn(
        "vec", F.when(F.col(id_col) == pad_id, zeros.cast(table.schema["vec"].dataType)).otherwise(F.col("vec"))
    ).drop("_token")
