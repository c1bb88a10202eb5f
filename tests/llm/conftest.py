import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows; it has a column whose name clashes with results."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x") for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text."""
    return docs_of([(1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "a" * 50_000), (6, "ab " * 20_000), (7, "été 日本 \U0001f600 ok"), (8, "x\u0000y"), (9, "one", None)])
