import pytest

from binroute.llm import workers


@pytest.fixture(autouse=True)
def _workers(spark):
    workers.prepare(spark)


@pytest.fixture
def texts(spark):
    """Documents from ``(doc_id, text)`` with extra columns whose names the operators use themselves."""

    def build(*rows):
        extra = ("x", 7, "y", "z", 1.5, "k")
        schema = "doc_id long, text string, digest string, n_words int, node string, class string, rank double, kept string"
        return spark.createDataFrame([(*row, *extra) for row in rows], schema)

    return build
