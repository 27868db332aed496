import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridfold.session import get_spark

    wh = tempfile.mkdtemp(prefix="gridfold-wh-")
    s = get_spark("local[*]", app="gridfold-tests", shuffle_partitions=8,
                  extra={"spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


@pytest.fixture()
def landing(tmp_path):
    d = tmp_path / "landing"
    d.mkdir()
    return d
