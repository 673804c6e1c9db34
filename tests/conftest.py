import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from siftbase.session import local_session

    # Short jobs: compiling everything to the last costs more than it gives.
    return local_session(4, spark__sql__shuffle__partitions="4", spark__driver__extraJavaOptions="-XX:TieredStopAtLevel=1")
