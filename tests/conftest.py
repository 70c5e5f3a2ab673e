import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

from trovine.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TROVINE_SF_DIR", "/root/testdata/sf0.001")
