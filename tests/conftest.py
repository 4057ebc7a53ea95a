import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from wardline import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "wardline-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def heavy(spark):
    """Every key counts as heavy and is cut into pieces."""
    spark.conf.set("wardline.hot.rows", "0")
    spark.conf.set("wardline.hot.pieces", "5")
    yield spark
    spark.conf.unset("wardline.hot.rows")
    spark.conf.unset("wardline.hot.pieces")


@pytest.fixture(scope="session")
def sf():
    return SF
