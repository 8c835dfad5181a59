import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from contrapair.session import local_session

    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def near():
    def check(a, b, tol=1e-9):
        assert a is not None and b is not None and abs(a - b) <= tol * max(1.0, abs(b)), (a, b)

    return check
