import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("QUILLMARK_DRIVER_MEMORY", "4g")
    s = local_session(4, 4)
    yield s


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
