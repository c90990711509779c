import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from framelane import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session.build(
        "local[8]",
        partitions=8,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    session.release_cuts(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL
