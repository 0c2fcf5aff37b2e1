import os

import pytest

from tidewright.session import local_session, release


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=os.environ.get("TEST_CPUS", "8"))
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
