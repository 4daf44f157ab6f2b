import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidebar.session import build_session

    work = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests", 4, **{"spark.sql.warehouse.dir": f"file://{work}/warehouse", "spark.checkpoint.dir": f"file://{work}/shared", "spark.driver.memory": "3g"}
    )
    yield session
    session.stop()
