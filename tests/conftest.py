import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tideline.session import get_session

    session = get_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def sf():
    """A folder of small driver tables."""
    return "/root/testdata/sf0.001"
