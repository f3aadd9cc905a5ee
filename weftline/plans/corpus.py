"""From a text corpus to training blocks and rank shards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids as I
from ..operators.loader import collate, shard_batches
from ..operators.packing import char_ids, pack_batches, pack_global


def byte_length(text: str = "text") -> Column:
    """Ids of a document: its bytes and the end mark; a NULL text has the end mark alone."""
    return F.coalesce(I.byte_count(text), F.lit(0)) + 1


def corpus_blocks(
    corpus: DataFrame,
    block_size: int = 8192,
    batch_rows: int | None = 1000,
    order: Sequence[str] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Blocks of byte ids with their mask, packed per batch or (``None``) over all.

    Text is laid out, cut and put together as strings; ids, four bytes for each byte
    of text, exist only in the finished blocks.
    """
    slim = corpus.select(*order, text)
    build = {"_chars": I.byte_chars(F.coalesce(text, F.lit("")))}
    if batch_rows is None:
        blocks = pack_global(slim, ["_chars"], block_size, order, byte_length(text), build, chars=True)
    else:
        blocks = pack_batches(
            slim, ["_chars"], block_size, batch_rows, order, byte_length(text), build, chars=True
        )
    ids = char_ids("_chars")
    return blocks.withColumns(
        {"input_ids": ids, "attention_mask": F.array_repeat(F.lit(1), F.char_length("_chars"))}
    ).drop("_chars")


def encoded_blocks(
    encoded: DataFrame, block_size: int = 8192, batch_rows: int | None = 1000, order: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Blocks of documents that are ids already (``input_ids``), each with its end mark, and their mask.

    A NULL document has the end mark alone. The mask of a block is made from its ids.
    """
    rows = encoded.select(*order, _with_end(F.col("input_ids")).alias("input_ids"))
    if batch_rows is None:
        return _masked(pack_global(rows, ["input_ids"], block_size, order))
    return _masked(pack_batches(rows, ["input_ids"], block_size, batch_rows, order))


def coded_blocks(
    corpus: DataFrame,
    ids: Callable[[Column], Column],
    n_ids: Callable[[Column], Column],
    block_size: int = 8192,
    batch_rows: int | None = 1000,
    order: Sequence[str] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """``encoded_blocks`` of texts: ``ids`` and ``n_ids`` give the ids of a column of words, and their number.

    Texts are laid out by the number alone and are what moves; ids are made where the blocks are.
    """
    slim = corpus.select(*order, text)
    length = F.coalesce(n_ids(I.words(text)), F.lit(0)) + 1
    build = {"input_ids": _with_end(ids(I.words(text)))}
    if batch_rows is None:
        return _masked(pack_global(slim, ["input_ids"], block_size, order, length, build))
    return _masked(pack_batches(slim, ["input_ids"], block_size, batch_rows, order, length, build))


def _with_end(ids: Column) -> Column:
    return I.append_eos(F.coalesce(ids, F.array().cast("array<int>")))


def _masked(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("attention_mask", I.ones_like("input_ids"))


def corpus_to_ranks(
    corpus: DataFrame, world_size: int, batch_size: int = 1, block_size: int = 8192, even: bool = False
) -> DataFrame:
    """Rank shards of loader batches over full blocks.

    ``block_no`` is dense already, so a batch is a division away and the corpus is
    packed once; how many batches there are follows from the lengths of the texts.
    """
    blocks = corpus_blocks(corpus, block_size, None)
    n_batches = None
    if even:
        n_ids = corpus.agg(F.sum(byte_length())).first()[0] or 0
        n_batches = -(-(n_ids // int(block_size)) // int(batch_size))
    batches = collate(blocks, F.col("block_no"), ["input_ids", "attention_mask"], batch_size)
    return shard_batches(batches, world_size, even, n_batches)
