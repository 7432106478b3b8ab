import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "alpha beta gamma delta " * 60_000


@pytest.fixture(scope="session")
def make(spark):
    def make(texts, schema="doc_id long, text string"):
        rows = [(i, t) for i, t in enumerate(texts)] if texts and not isinstance(texts[0], tuple) else list(texts)
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash with added ones."""
    rows = [
        (0, None, None, None, None, 1, "x", 0.5), (1, "", "en", "s", 0, None, None, None), (None, "no id here at all but words", "en", "s", 3, 1, "y", 0.1),
        (2, LONG, "en", "s", 9, 2, "z", 0.2), (3, "same words in two rows of it", "en", "s", 9, 2, "z", 0.2), (3, "same words in two rows of it", "en", "s", 9, 2, "z", 0.2),
        (4, "  \t\n ", "fr", "s", 4, 2, "z", 0.2), (5, "é" * 50, "fr", "s", 4, 2, "z", 0.2), (6, "😀 1.2.3.4 a@b.co", "de", "s", 4, 2, "z", 0.2),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept long, row string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
