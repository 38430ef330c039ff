import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from reelscope.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8, app="reelscope-tests")
    yield s


@pytest.fixture(scope="session")
def raw_dir():
    return os.path.join(FIXTURES, "raw", "Sample Film")
