import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trellis.session import get_session

    s = get_session("local[4]", partitions=4, app="trellis-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_TINY
