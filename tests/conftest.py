import pytest

from marlstone.session import drop_scratch, get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", "tests", spark__sql__shuffle__partitions=4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()
