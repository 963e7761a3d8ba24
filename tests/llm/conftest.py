import random

import pytest
from texts import prose


@pytest.fixture
def rnd():
    return random.Random(11)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names the operators use inside."""
    def make(rows):
        full = [(i, t, lang, s, None if t is None else len(t), 7, "x", "y", 1, [3]) for i, t, lang, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "k1 int, K2 string, spans string, n_lines int, ids array<int>")

    return make


@pytest.fixture
def odd_rows(rnd):
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal ids."""
    long = prose(rnd, 20_000)
    plain = prose(rnd, 120)
    return [
        (1, plain, "en", "a"), (1, plain, "en", "a"), (2, plain, "en", "a"), (None, plain, None, None),
        (3, None, "en", None), (4, "", None, "a"), (5, " \n\t \n", "en", "a"), (None, None, None, None),
        (6, long, "en", "a"), (7, "x" * 50_000, "en", "a"), (1, prose(rnd, 90), "de", "b"), (8, "one", "en", "a"),
        (9, "\x00\x01   é 漢字 👩‍👧 " + "!" * 3000, "zz", "a"),
    ]
