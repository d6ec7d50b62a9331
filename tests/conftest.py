import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).resolve().parent.parent, Path(__file__).resolve().parent):
    sys.path.insert(0, str(folder))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from storyspark.session import local_session

    session = local_session(8, "storyspark-tests")
    session.sparkContext.setLogLevel("OFF")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
