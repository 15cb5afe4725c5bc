import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    sys.path.insert(0, path)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from feedloom.session import local_session

    return local_session("8", shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf():
    return SF
