import pytest

from anontext.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "anontext-tests", shuffle_partitions=4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
