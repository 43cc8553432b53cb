import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from edge_rows import CLASH, edge_documents  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(d, t, k, "s", "c", k, "p", None) for k, (d, t) in enumerate(edge_documents())]
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture
def small_limits(monkeypatch):
    """Set module constants for one test."""
    return lambda module, **values: [monkeypatch.setattr(module, k, v) for k, v in values.items()]
