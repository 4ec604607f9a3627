import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from quillmark.session import local_session, ship

    session = ship(local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}))
    yield session
    session.stop()
