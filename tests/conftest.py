import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from revlens.session import get_session
    s = get_session("local[4]", app="revlens-tests", shuffle_partitions=8, driver_memory="10g")
    yield s
    s.stop()
