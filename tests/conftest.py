import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(os.environ.get("TEST_CPUS", "8"))


@pytest.fixture(scope="session")
def catalog(spark):
    from kvartal.sources import catalog as cat

    return cat.read(spark, os.path.join(ROOT, "tests", "fixtures", "catalog.json"))
