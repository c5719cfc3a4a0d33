from __future__ import annotations

import pytest

ROWS = [
    (1, "One two three four five six seven eight.\nA second line of words is here, and it goes on.", "en", "a", 90),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "A row without an id, kept as it is where that makes sense.", "en", "b", 58),
    (5, "One two three four five six seven eight.\nA second line of words is here, and it goes on.", "en", "b", 90),
    (5, "One two three four five six seven eight.\nA second line of words is here, and it goes on.", "en", "b", 90),
    (7, "   \t\n ", "de", "", 6),
    (8, "lone", "de", "c", 4),
    (9, "word " * 30000, "en", "a", 150000),
    (10, "é ß   \U0001f600 | #$% <b>", "fr", "c", 18),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and a column whose name operators use themselves."""
    rows = [(*r, f"x{i}", i) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, rank long").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
