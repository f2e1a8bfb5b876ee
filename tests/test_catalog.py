"""Every registered query at the smallest scale, against its SQL twin where it has one."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["column"] for r in rows} == {"gender_norm", "age_group", "ethnicity_norm"}
