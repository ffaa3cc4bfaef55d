from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sessionflow.session import local_session

    s = local_session("*", shuffle_partitions=8, app="sessionflow-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tests.compare import duck

    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_mid():
    from tests.compare import duck

    return duck(SF_MID)
