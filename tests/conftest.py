import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pairmine.session import get_spark
    os.environ.setdefault("TMPDIR", tempfile.mkdtemp(prefix="pairmine-tests-"))
    s = get_spark("local[4]", 4, app="pairmine-tests", driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="pairmine-t-")
