import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quadrat.session import session

    s = session("tests", master="local[4]", partitions=4)
    yield s
    s.stop()
