import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trailwarden.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "6g",
        "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false",
        # several sort parts even for tiny frames, so that carried state is exercised
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    })


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
