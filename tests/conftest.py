import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quotaloom import catalog  # noqa: E402
from quotaloom.plans.registry import Tables  # noqa: E402
from quotaloom.session import get_session  # noqa: E402

from settings import AS_OF, SF_SMALL  # noqa: E402,F401


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.driver.host": "127.0.0.1"})
    session.sparkContext.setLogLevel("ERROR")
    catalog.load()
    return session


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SF_SMALL)
