import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from paths import SF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tillwatch.session import local_session
    return local_session(8, "tests")


@pytest.fixture(scope="session")
def tickets(spark):
    from tillwatch.plans.facts import tickets as fact
    from tillwatch.session import write_shared
    return write_shared(fact(spark, SF), "test-tickets")
