import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from strandline.session import local_session

    s = local_session(cores=8, memory="6g", partitions=8, app="tests")
    yield s
    s.stop()
