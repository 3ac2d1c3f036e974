import pytest

from stepwright.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "8g")
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return SMALL
