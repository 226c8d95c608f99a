import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents-like rows from texts (ids from 0), with columns whose names clash with the operators' own."""

    def make(texts, start=0):
        rows = [(start + i, t, "en" if t and i % 2 else "fr", f"src{i % 3}", len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n_tokens int, label string")

    return make


EDGE = [None, "", " ", "\n\n", "word", "word", "é", "a b", "x" * 20000, "one two three " * 4000, "日本語 テスト", "\x00 \x1c   z"]


@pytest.fixture(scope="session")
def edge():
    return EDGE
