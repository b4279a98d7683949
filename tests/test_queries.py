"""Every registered query at the smallest scale, against its SQL where it has one."""

import pytest

from tests.check_oracle import compare, duck
from wavelark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        problem, _ = compare(df, ORACLES[name], con)
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_plain_sql_entries_only():
    assert set(ORACLES) <= set(QUERIES)
