import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from minuteworks.session import local_session, ship

    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
