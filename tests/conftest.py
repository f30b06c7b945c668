import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegauge.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", shuffle_partitions=4)
    yield s
    s.stop()
