import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from stipple.session import local_session

    s = local_session("8", shuffle_partitions=8, app="stipple-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
