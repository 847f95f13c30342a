import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from scoreloom.session import session

    out = session("4", 4)
    out.sparkContext.setLogLevel("ERROR")
    return out
