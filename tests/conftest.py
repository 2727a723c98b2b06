import pytest

from hopgrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", spark__sql__shuffle__partitions="4", spark__sql__autoBroadcastJoinThreshold="1m")
