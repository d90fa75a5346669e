import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as documents: (doc_id, text) with any further columns."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make
