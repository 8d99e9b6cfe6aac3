import pytest

LONG = " ".join(f"w{i % 5000}x{i % 7}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns whose names clash."""
    line = "A line of more than forty characters that many documents share."
    rows = [
        (1, "One two three four five six seven eight nine ten.\n" + line, "en", "h1"), (2, None, "en", "h1"), (3, "", None, None), (4, LONG, "de", "h2"),
        (5, LONG, "de", "h2"), (6, "one, TWO three four five six seven eight nine ten\n" + line.upper() + "  ", "en", None),
        (7, line, "fr", "h3"), (7, line, "fr", "h3"), (8, "\t" + line + "\n" + line, "fr", "h3"), (None, line + "\nÄ", "fr", "h3"), (9, "!!! 123 ...", "de", "h1"),
        (10, "a", None, "h2"), (11, "x" * 30_000, "en", "h2"), (12, "\n\n \n", "en", "h1"), (13, "ab " * 400, "es", "h1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "'c' as score", "1 as n_words", "2 as n", "'b' as body", "3 as k0", "4 as id", "5 as node", "6 as shard", "7 as kept", "8 as host_failed",
                         "9 as contaminated", "10 as n_lines", "11 as start")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
