from __future__ import annotations

import pytest

from tideline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    from tests.compare import views

    return views("/root/testdata/sf0.001")
