"""Every query that has check SQL against DuckDB on the smallest tables."""

import pytest

import __spark_entry__
from tests.compare import difference, duck
from tests.conftest import SAMPLE

CHECKED = sorted(__spark_entry__.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SAMPLE)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SAMPLE)
    assert difference(df, con, __spark_entry__.oracle_sql()[name]) is None


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
