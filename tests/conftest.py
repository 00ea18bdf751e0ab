import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barline.session import local_session  # noqa: E402
from barline.sources.market import Market  # noqa: E402
from tables import SF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def market(spark):
    return Market(spark, SF)
