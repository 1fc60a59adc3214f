import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vectorloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame_of(spark, values, ids=None):
    ids = range(len(values)) if ids is None else ids
    return spark.createDataFrame(
        [(int(k), [float(x) for x in v]) for k, v in zip(ids, values)], "i bigint, features array<double>"
    )
