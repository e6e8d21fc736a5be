import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of (doc_id, text, slot, extra) from a list of texts; the last two only get in the way."""

    def make(texts, ids=None):
        rows = [(i, t, "x", None) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, slot string, extra string")

    return make
