"""Small tables with the cases that every operator must stand."""

import pytest

LONG = "word" + " and then another word here" * 30_000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today again"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today again"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, "é日本\U0001f600 ünï ▁ <|endoftext|> x"),
    (None, "no id here"),
    (8, "the quick"),
    (8, "the quick"),
]


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en", "s" if (i or 0) % 2 else None, 1, "x", 2.0, [1], "r") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, fp double, spans array<int>, row string").repartition(3)


@pytest.fixture
def none(odd):
    return odd.where("false")
