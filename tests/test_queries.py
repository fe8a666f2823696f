"""Every registered query of the library's own operators: against its SQL where there is one, else that it runs."""

import os

import pytest

from gapwise.queries.catalog import ORACLES, QUERIES
from support import SF, duck, duck_rows, spark_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert spark_rows(df) == duck_rows(con, ORACLES[name])
    else:
        assert df.count() >= 0


def test_all_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
