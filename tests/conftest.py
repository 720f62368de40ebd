import pytest

from terrasift.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "terrasift-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
