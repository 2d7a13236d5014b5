import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_rows import ROWS, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and names that operators use inside."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
