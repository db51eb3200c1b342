import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from revlens.session import get_session
    s = get_session("local[8]", shuffle_partitions=4, app_name="revlens-tests",
                    extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()
