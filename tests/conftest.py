import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import session  # noqa: E402
from stagewise.session import configure, ship_packages  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return ship_packages_to(configure(session("4")))


def ship_packages_to(spark):
    ship_packages(spark, "stagewise", "workload")
    return spark
