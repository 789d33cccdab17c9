import pytest

from postlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("postlake-tests", master="local[8]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
