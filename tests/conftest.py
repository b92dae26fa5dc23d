import pytest

from timberline.session import local


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return session
