"""Small tables with every awkward case."""

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, copies, a very long text, and columns whose names
    clash with those used inside the operators."""
    long = " ".join(f"word{i % 997} tail{i}" for i in range(60_000))
    body = "First line of the text here.\nSecond line, which is longer than the first one is.\nThird line to end it all with words."
    rows = [
        (1, body, "en", "a", 1), (2, body, "en", "a", 1), (2, body, "en", "a", 1), (3, None, "en", "a", None), (4, "", None, "b", 0),
        (5, " \n\t\n ", "en", None, 4), (None, body, "en", "a", 1), (None, None, None, None, None), (6, "one", "en", "c", 3), (7, "one two", "en", "c", 7),
        (8, long, "en", "b", 1), (9, body + "\nAnother line follows the others.", "en", "b", 1), (10, "ÄÖ ß Привет 日本 𝒳  wide space", "de", "c", 1),
    ]
    df = spark.createDataFrame(rows, KIND)
    for name in ("id", "hash", "start", "end", "_in", "_w", "_t", "node", "key", "size", "digest", "fp", "kept", "n_words", "spans", "label", "row", "copies", "_cut", "keep"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
