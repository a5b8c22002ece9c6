import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import DOCS, awkward_rows, frame  # noqa: E402


@pytest.fixture(scope="session")
def awkward():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return frame(spark, awkward).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
