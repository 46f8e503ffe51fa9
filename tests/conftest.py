import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyrank.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8, tempfile.mkdtemp(prefix="tallyrank-test-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture
def tmp(spark):
    from tallyrank.session import scratch_path
    return lambda name: scratch_path(spark, name)
