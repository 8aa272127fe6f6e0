import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of given (doc_id, text) pairs, with a column that clashes."""

    def make(rows, extra="n_words"):
        data = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra} string")

    return make
