import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from heron.session import session

    s = session("local[4]", 4, spark__driver__memory="4g", spark__sql__warehouse__dir=tempfile.mkdtemp(), spark__sql__shuffle__partitions="4")
    yield s
    s.stop()
