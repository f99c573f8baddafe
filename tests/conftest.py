import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidewater.session import importable_on_workers, session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session(4, 4, app="tests", spark__driver__memory="4g")
    importable_on_workers(s)
    yield s
    s.stop()
