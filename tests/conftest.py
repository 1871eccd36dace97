import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from thicketry.session import local_session

    s = local_session("tests", 4, 4, "3g")
    yield s
    s.stop()
