import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kithlink.session import local_session
    session = local_session("8", "kithlink-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    # the smallest tables have single records only; these have persons with several
    return "/root/testdata/sf0.01"
