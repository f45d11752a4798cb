import os
import sys as _sys
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from mmcohort.session import local_session

    s = local_session("*", shuffle_partitions=8, app="mmcohort-tests")
    yield s
    s.stop()
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
