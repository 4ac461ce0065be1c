import pytest

from musterbook.model import ATTEND_SCHEMA, EMP_SCHEMA, HOLIDAY_SCHEMA, LEAVE_SCHEMA, Tables
from musterbook.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tables(spark):
    def make(emp=(), attend=(), leave=(), holidays=()):
        return Tables(
            spark.createDataFrame(list(emp), EMP_SCHEMA),
            spark.createDataFrame(list(attend), ATTEND_SCHEMA),
            spark.createDataFrame(list(leave), LEAVE_SCHEMA),
            spark.createDataFrame([(d,) for d in holidays], HOLIDAY_SCHEMA),
        )

    return make
