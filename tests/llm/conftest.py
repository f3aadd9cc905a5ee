import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

PROSE = (
    "The river ran high after the rain, and the old mill at its bank turned slowly. "
    "People of the village said that nobody had worked there for years, but on some nights "
    "a lamp burned in the upper window. Children told each other stories about it on the way "
    "home from school, and none of them went near the place alone. In the spring a stranger "
    "came with two horses and a cart full of books, asked for the key, and opened the door."
)


def documents(spark, rows, extra=()):
    """Rows of (doc_id, text[, lang]) as documents, with extra columns of any name."""
    schema = T.StructType([*DOCUMENTS, *[T.StructField(c, T.StringType()) for c in extra]])
    full = []
    for row in rows:
        doc_id, text, lang = (*row, "en")[:3]
        full.append((doc_id, text, lang, "src0", None if text is None else len(text), *["x"] * len(extra)))
    return spark.createDataFrame(full, schema)


#: NULL, empty, separators alone, one word, repeated rows, one doc_id twice, no doc_id, a very long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "word"),
    (5, PROSE),
    (5, PROSE),
    (6, PROSE),
    (6, "Another text under the same number."),
    (None, PROSE),
    (None, None),
    (7, "é" * 30_000 + " " + "a" * 300_000),
    (8, " ".join(f"w{i}" for i in range(60_000)), None),
    (9, PROSE.upper(), None),
    (10, "٣١   \U0001f600 你好", "zz"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD, ["kept", "node", "digest", "_sha256", "_node", "length", "start", "piece", "n_words", "learned"])


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
