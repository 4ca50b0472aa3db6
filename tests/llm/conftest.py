import os
import sys

import pytest

from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("row", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("words", T.StringType()),
        T.StructField("k1", T.StringType()),
        T.StructField("n_words", T.StringType()),
    ]
)

PROSE = (
    "the quick brown fox jumps over the lazy dog and then it runs to the river with a friend "
    "who was on the way to town for the market that opens in the morning as it is every day"
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, sources=None):
        rows = [
            (
                ids[k] if ids is not None else k,
                t,
                "en",
                sources[k] if sources else f"s{k % 3}",
                len(t) if t is not None else None,
                "r", "k", "w", "1", "n",
            )
            for k, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, marks, non-ASCII, a very long text, repeats."""
    return [
        None,
        "",
        " \t\n",
        "word",
        "*** $$$ ###",
        "Größe ünd ñandú   été 日本語 😀   end",
        ("long " * 9 + "line\n") * 4000,
        PROSE,
        PROSE,
        "x" * 100_000,
        "\0 nul  two  spaces ",
    ]


@pytest.fixture(scope="session")
def vocabulary():
    from revlens.llm.queries import vocabulary

    return vocabulary()
