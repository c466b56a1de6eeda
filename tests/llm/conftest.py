"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

SF = "/root/testdata/sf0.001"

LONG = "".join(f"word{i % 977} and the other, " for i in range(20_000)) + "\n" + "9" * 5000 + " " + "a" * 5000
TEXTS = [
    (1, "The cat sat on the mat. The dog ran to the house, and the bird sang a song for all of us there.\n" * 3),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "same text here again"),
    (6, "same text here again"),
    (7, " \t\n "),
    (8, "Ünïcödé 漢字 emoji 😀 nbsp here　wide <|endoftext|> <|startoftext|> I'll we're don't\x1cx\x85y"),
    (8, "Ünïcödé 漢字 emoji 😀 nbsp here　wide <|endoftext|> <|startoftext|> I'll we're don't\x1cx\x85y"),
    (None, "a document without a key, and some words in it"),
    (9, "x"),
    (10, "##|| $$%% &&** " * 40),
]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with odd rows, and columns whose names clash with the operators' own."""
    rows = [(k, t, "en" if i % 2 else None, "s", None if t is None else len(t), 1, "x", 0.5) for i, (k, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int, chunk string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
