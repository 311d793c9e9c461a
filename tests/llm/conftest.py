import pytest

ODD_TEXTS = [None, "", " ", "\n\n", "one", "two words", "a b c d e f g", "tab\tand\nline", "ünï çödé 日本語 😀", "x " * 3000, "same text here for all of us", "same text here for all of us"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(i if i != 3 else None, t, 1, "en", "k") for i, t in enumerate(ODD_TEXTS)] + [(5, "two words", 2, "de", "x"), (5, "two words", 2, "de", "x"), (7, "other", 3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string, score string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
