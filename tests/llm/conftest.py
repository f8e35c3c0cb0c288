import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of a schema text and rows, over two partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(2)

    return make
