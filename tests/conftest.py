import pytest

from strandworks.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", name="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
