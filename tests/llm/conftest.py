import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, spans string, n int, hash long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with names the operators use."""
    long_text = "word salad over the hills, far away. " * 8000
    base = [
        (1, "one two three four five six seven eight nine ten", "en", "a/x"),
        (1, "one two three four five six seven eight nine ten", "en", "a/x"),
        (2, "", "en", "b/x"),
        (3, None, None, None),
        (None, "one two three four five six seven eight nine ten", "en", "a/y"),
        (4, " \t\n ", "de", "b/x"),
        (5, long_text, "en", "c/x"),
        (6, "...!!! 123 456", None, "c/x"),
        (7, 'token = "abcdefgh12345678" <|im_end|> é 日本', "fr", None),
        (8, "x", "es", "d/x"),
    ]
    rows = [(i, t, g, s, None if t is None else len(t), 0.5, 1, "s", 2, 3) for i, t, g, s in base]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
