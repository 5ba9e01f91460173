import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cluemill.session import local_session

    return local_session(4, partitions=4, **{"spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def data():
    return DATA
