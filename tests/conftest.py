import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import session

    root = tmp_path_factory.mktemp("spark")
    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(root / "warehouse"), "spark.checkpoint.dir": f"file://{root / 'shared'}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
