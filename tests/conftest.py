import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import TASK_ROWS_KEY, build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def small_tasks(spark):
    """Pretend a task holds only 40 rows, so every operator takes the path meant for large data."""
    spark.conf.set(TASK_ROWS_KEY, "40")
    yield 40
    spark.conf.unset(TASK_ROWS_KEY)


@pytest.fixture
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
