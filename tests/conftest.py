import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from noteloom.session import local_session

    return local_session(cores=4, memory="3g", shuffle_partitions=4, app="tests")
