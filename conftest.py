"""One local session for all tests."""

import pytest


@pytest.fixture(scope="session")
def spark():
    from phonosearch.session import local_session

    session = local_session(cores="4", name="tests", partitions=4)
    yield session
    session.stop()
