import pytest

from tallywise.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", master="local[8]", shuffle_partitions=8, scratch=str(tmp_path_factory.mktemp("scratch")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
