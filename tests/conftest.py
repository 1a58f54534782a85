import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from halyard.session import session

    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", f"--driver-memory 4g --conf spark.sql.warehouse.dir={tmp_path_factory.mktemp('warehouse')} pyspark-shell")
    os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
    out = session("tests", "local[4]", 4)
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
