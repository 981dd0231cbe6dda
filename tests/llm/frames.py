"""The fixture that the tests here share (not a conftest: tests/ has one already)."""

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema): a small table with a clashing extra column of each name."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
