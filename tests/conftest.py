import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tickloom-tests")
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Let one window task hold only a few rows, so that every ordered group is cut into blocks."""
    from tickloom.operators.groups import GROUP_ROWS

    spark.conf.set(GROUP_ROWS, "7")
    yield
    spark.conf.unset(GROUP_ROWS)
