from __future__ import annotations

import pytest

LONG = "long words here and there " * 4000
#: null, empty, blank, very long, repeated rows, a null id and an id twice with different texts.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "a b c d e f g"), (None, "a b c d e f g"),
    (None, "nothing like it at all here"), (7, "one text"), (7, "another text of the same id"), (8, "x"), (9, "É😀 \x00 <|endoftext|> it's\r\n"),
]


@pytest.fixture
def odd(spark):
    """Columns that operators might use themselves come along."""
    rows = [(i, t, "en", "s", 1, 2, "x", 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, length int, rank int, sid string, score double")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
