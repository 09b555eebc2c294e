import pytest

from ledgerloom.session import session


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", 4)
