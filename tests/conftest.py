import pytest

from gridstrata.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
