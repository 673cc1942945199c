import pytest

from shelfmark.session import get_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", "8", 4)


@pytest.fixture(scope="session")
def data():
    return DATA
