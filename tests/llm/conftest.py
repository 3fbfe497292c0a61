import pytest


@pytest.fixture()
def documents(spark):
    """A table with clashing extra columns: rows (doc_id, text)."""

    def make(rows, more="id string, h long, key string, class int, kept boolean, slot long"):
        extra = (None,) * len(more.split(","))
        return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {more}")

    return make
