import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs with extra columns, one of a clashing name."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, block string, extra array<int>")

    return make
