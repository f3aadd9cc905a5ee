"""Token id contract and the column functions that build id sequences.

Everything here is a built-in Spark expression: no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The ids shared by every tokenizer of this package.
BOS, PAD, EOS, UNK = 0, 1, 2, 3
SPECIAL_IDS = {
    "<s>": 0,
    "<pad>": 1,
    "<eos>": 2,
    "<unk>": 3,
    "<image>": 4,
    "</image>": 5,
    "<audio>": 6,
    "</audio>": 7,
    "<video>": 8,
    "</video>": 9,
    "<any>": 10,
    "</any>": 11,
}
FIRST_PAYLOAD_ID = 12
MEDIA = ("image", "audio", "video", "any")

# Stands for the end mark among bytes, which are the characters up to 255.
END_CHAR = "\u0100"

WORD_PATTERN = r"[\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ints(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


def special_id(name: Column | str) -> Column:
    """Id of a special token given by name; NULL for any other string."""
    pairs = [F.lit(x) for item in SPECIAL_IDS.items() for x in item]
    return F.create_map(*pairs)[_col(name)]


def markers(media: Sequence[str]) -> list[int]:
    """Opening and closing marker ids of the given media, in order."""
    return [SPECIAL_IDS[t] for m in media for t in (f"<{m}>", f"</{m}>")]


def byte_ids(text: Column | str) -> Column:
    """UTF-8 bytes of a text as ids.

    Reading the bytes back as ISO-8859-1 gives one character per byte, so the
    split and the code points stay inside the JVM.
    """
    chars = F.split(F.decode(F.encode(_col(text), "UTF-8"), "ISO-8859-1"), "")
    ids = F.transform(chars, lambda c: F.ascii(c) + F.lit(FIRST_PAYLOAD_ID))
    empty = F.array().cast("array<int>")
    return F.when(F.octet_length(_col(text)) > 0, ids).when(_col(text).isNotNull(), empty)


def byte_count(text: Column | str) -> Column:
    """Length of ``byte_ids`` without building it."""
    return F.octet_length(_col(text)).cast("bigint")


def byte_chars(text: Column | str) -> Column:
    """A string with one character per id: the text's bytes, then the end mark.

    Strings of any length are cheap to cut and to shuffle; ``ids_of_chars`` makes the
    ids once the pieces are short.
    """
    return F.concat(F.decode(F.encode(_col(text), "UTF-8"), "ISO-8859-1"), F.lit(END_CHAR))


def ids_of_chars(chars: Column | str) -> Column:
    """Ids of a string made by ``byte_chars`` or of a piece of it."""
    codes = F.transform(F.split(_col(chars), ""), lambda c: F.ascii(c))
    return F.transform(
        codes, lambda x: F.when(x == ord(END_CHAR), F.lit(EOS)).otherwise(x + F.lit(FIRST_PAYLOAD_ID))
    )


def words(text: Column | str) -> Column:
    """The words of a text, in order: maximal runs of letters and digits."""
    return F.regexp_extract_all(_col(text), F.lit(WORD_PATTERN), 0)


def append_eos_text(text: Column | str, eos: str = "<eos>") -> Column:
    return F.concat(_col(text), F.lit(eos))


def append_eos(ids: Column | str) -> Column:
    return F.concat(_col(ids), _ints([EOS]))


def add_bos(ids: Column | str) -> Column:
    return F.concat(_ints([BOS]), _col(ids))


def truncate(ids: Column | str, n: int) -> Column:
    return F.slice(_col(ids), 1, n)


def pad_to(ids: Column | str, length: Column, pad_id: int = PAD) -> Column:
    """Right-pad to ``length``; a longer sequence stays as it is."""
    ids = _col(ids)
    missing = F.greatest(length - F.size(ids), F.lit(0)).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(pad_id), missing))


def splice_after_first(ids: Column | str, values: Sequence[int]) -> Column:
    """``[t0] + values + [t1, ...]``; an empty sequence becomes ``values``."""
    ids = _col(ids)
    rest = F.slice(ids, F.lit(2), F.greatest(F.size(ids), F.lit(0)))
    return F.concat(F.slice(ids, 1, 1), _ints(values), rest)


def attention_mask(ids: Column | str, pad_id: int = PAD, prefix: int = 64) -> Column:
    """``prefix`` ones for the feature slots, then 1 where the id is not padding."""
    body = F.transform(_col(ids), lambda x: (x != F.lit(pad_id)).cast("int"))
    return F.concat(F.array_repeat(F.lit(1), prefix), body) if prefix else body


def ones_like(ids: Column | str) -> Column:
    """Attention mask of an unpadded sequence."""
    return F.array_repeat(F.lit(1), F.size(_col(ids)))


def checksum(ids: Column | str) -> Column:
    """Order-sensitive digest of an id array: MD5 of its comma-joined values."""
    return F.md5(F.array_join(_col(ids).cast("array<string>"), ",").cast("binary"))
