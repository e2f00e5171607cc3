import pytest

from letterloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        "letterloom-tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
