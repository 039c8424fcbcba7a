import pytest

from loadlens.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "loadlens-tests", "local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__driver__memory="8g",
        spark__sql__streaming__noDataProgressEventInterval="100")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
