import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, _key long, h string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text, source); it also has columns with names that operators like to use."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, s, None, 0.25, 7, "x") for i, t, s in rows], COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in any column, empty texts, repeated rows, white space of all kinds, letters of several widths."""
    text = "Ça va \t über 漢字 \x0b and a plain end\nÇa va \t über 漢字 \x0b and a plain end\n\n 😀 last line of this one"
    return documents([
        (None, None, None), (None, "only words here", "a"), (1, "", "a"), (2, None, "a"), (3, " \n\t ", None), (4, text, "b"), (4, text, "b"), (4, "another text", "b"),
        (5, "x", ""), (6, "word " * 3000, "b"), (7, text.upper(), "c"), (8, text, None), (9, "a b c d e f g h\na b c d e f g h\na b c X e f g h", "c")])
