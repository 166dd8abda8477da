import pytest

from sedgewren.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g",
        spark__sql__streaming__forceDeleteTempCheckpointLocation="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
