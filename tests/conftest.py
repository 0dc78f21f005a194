import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemill.session import get_session, ship_package

    s = get_session("tests", cores=4, shuffle_partitions=4, spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture
def db(spark, tmp_path):
    from tidemill.store.connection import Database

    return Database(spark, str(tmp_path / "db")).connect()


@pytest.fixture
def plain(spark):
    """A connection without a store."""
    from tidemill.store.connection import Database

    return Database(spark).connect()
