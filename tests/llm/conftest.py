import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size int, h string, _row int, _matches int, kept int, taken int, grp int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns that clash with results."""
    long_text = " ".join(f"w{i % 977} x{i % 31}" for i in range(40_000))
    prose = " ".join(f"word{i} of the text" for i in range(60))
    rows = [
        (1, prose, "en", "a"), (2, prose, "en", "b"), (2, prose, "en", "b"), (3, prose + " end.", None, None),
        (4, None, "en", "a"), (5, "", "en", None), (6, " \t\n ", "en", "a"), (None, prose, "en", "c"),
        (None, None, None, None), (7, long_text, "en", "a"), (8, "one two", "en", "b"), (9, "ONE  two", "de", "b"),
        (10, "é " * 70, "fr", "é"), (11, "a\nb\na\n\n\n", "en", "b"),
    ]
    return spark.createDataFrame([(*r, 1, 1, 1, "h", 1, 1, 1, 1, 1) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
