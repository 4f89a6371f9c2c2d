import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from luxframe.session import local_session

    session = local_session("8", shuffle_partitions=4, memory="6g")
    yield session
    session.stop()
