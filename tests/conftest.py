import pytest

from motifold.session import local_session


@pytest.fixture(scope="session")
def shared_folder(tmp_path_factory):
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def spark(shared_folder):
    settings = {"spark.checkpoint.dir": str(shared_folder)}
    session = local_session("motifold-tests", partitions=8, settings=settings)
    yield session
    session.stop()
