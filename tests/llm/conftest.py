from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, an empty text, blanks only, a one-word text, ties, repeated rows, a text of 60,000 words.
ODD_ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "word", "en", "b", 4),
    (None, "a text without an id that is a little longer than ten words are", "en", "b", 60),
    (5, "the same text " * 12, "en", "b", 100),
    (6, "the same text " * 12, "fr", "c", 100),
    (6, "the same text " * 12, "fr", "c", 100),
    (7, "many words of a very long text number " * 7500, "de", "c", 1),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd rows, with extra columns whose names clash with the operators' own."""
    rows = [(*r, "x", 1, True) for r in ODD_ROWS]
    return spark.createDataFrame(rows, DOCUMENT + ", size string, key long, n_words boolean")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
