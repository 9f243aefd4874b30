import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int, rank string, fertility double, `group` int"


def prose(rng, words, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those that operators use inside."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), 7, "k", 3, "r", 0.5, 1) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, repeated rows, one text under several ids."""
    rng = random.Random(1)
    text = prose(rng, 60)
    return [
        (1, text, "en", "web"),
        (1, text, "en", "web"),
        (2, text, "en", "web"),
        (None, text, "en", "web"),
        (3, None, "en", "web"),
        (4, "", "de", "book"),
        (5, " \n\t ", "de", None),
        (6, prose(rng, 40), None, None),
        (7, prose(rng, 40_000), "fr", "web"),
        (8, "!!! ???", "en", "web"),
        (None, None, None, None),
    ]
