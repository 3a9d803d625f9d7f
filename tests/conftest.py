"""One session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import reach, session

    made = session("local[4]", shuffle_partitions=4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})
    made.sparkContext.setLogLevel("ERROR")
    reach(made)
    yield made
    made.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def medium() -> str:
    return f"{DATA}/sf0.01"
