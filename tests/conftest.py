import pytest

from causeway.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
