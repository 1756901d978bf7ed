import pytest


@pytest.fixture
def empty(spark):
    """An empty table of a given schema, with an extra column whose name an operator might use itself."""
    return lambda schema: spark.createDataFrame([], f"{schema}, n bigint, component string")
