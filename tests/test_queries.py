"""Every registered query against its SQL, at the small scale."""

import pytest

from tabloom.workloads import ORACLES, QUERIES
from tests.compare import check, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    said = check(spark, con, name, sf)
    assert said == "", said


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert ORACLES.items() <= entry.oracle_sql().items()
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "o_totalprice", "o_orderdate"] and df.count() > 0
