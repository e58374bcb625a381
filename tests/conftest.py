"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quarry.session import build_session

    shared = str(tmp_path_factory.mktemp("shared"))
    return build_session(4, "tests", **{"spark.checkpoint.dir": shared, "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})


@pytest.fixture(scope="session")
def sf():
    return SF
