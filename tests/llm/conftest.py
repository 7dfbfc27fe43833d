import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, doc string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls in every column, empty and long texts, ties, repeats, and extra columns with clashing names."""
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [
        (5, passage + " tail one", "en", "a", 1, 7, 0.5, "x"),
        (3, "head " + passage, "en", "b", 1, 7, 0.5, "x"),
        (9, passage + " tail one", "de", None, None, None, None, None),
        (9, passage + " tail one", "de", None, None, None, None, None),
        (7, None, None, None, None, None, None, None),
        (8, "", "en", "a", 0, 1, 0.1, ""),
        (11, " \t\n\x0b ", "en", "c", 5, 1, 0.1, ""),
        (None, "one two three", None, "a", 3, 1, 0.1, ""),
        (12, "One two THREE", "fr", "b", 3, 1, 0.1, ""),
        (13, "x", "fr", "b", 1, 1, 0.1, ""),
        (14, "long " * 60_000 + "end", "es", "c", 1, 1, 0.1, ""),
        (15, "été \U0001f600 naïve " * 20, "es", "c", 1, 1, 0.1, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
