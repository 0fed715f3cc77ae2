import pytest

EDGE = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, spans int, lead string, chunk int, first string, runs int, bad string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"w{k % 3000}x" for k in range(30000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1, 0.1, "x", 1, "y", 2), (2, "", "en", "a", 0, None, None, None, None, None), (3, None, None, None, None, 0.5, "z", 3, "q", 1),
        (None, "one two three four five six seven eight nine ten eleven", "en", None, 3, None, None, None, None, None), (5, long, "de", "b", 9, 0.2, "a", 1, "b", 3),
        (6, long, "de", "c", 9, 0.2, "a", 1, "b", 3), (7, "\n \t\r\n", "fr", "b", 4, None, None, 2, None, 1), (8, "é▁ ß\U0001f600 <|endoftext|> ### 12,3", "fr", "b", 4, None, None, 2, None, 1),
    ]
    return spark.createDataFrame([(*r, "f", 1, "b") for r in [*rows, rows[0], rows[4]]], EDGE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (5, 0, 1), (6, None, 0), (None, 1, 1), (7, 0, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
