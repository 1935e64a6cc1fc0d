import pytest

from tamis.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
