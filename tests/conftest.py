import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sigloom.session import local_session
    s = local_session(master="local[4]", partitions=4, app="sigloom-tests")
    yield s
    s.stop()
