import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cairnmap.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """DataFrame of (item_id, column) from a matrix, over some partitions."""

    def make(matrix, column="vector", ids=None, partitions=3):
        ids = range(len(matrix)) if ids is None else ids
        rows = [(int(i), [float(x) for x in row]) for i, row in zip(ids, matrix)]
        return spark.createDataFrame(rows, f"item_id long, {column} array<double>").repartition(partitions)

    return make
