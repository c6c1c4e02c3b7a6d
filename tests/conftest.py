import os

import pytest

os.environ.setdefault("HEDDLE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from heddle.session import local_session

    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
