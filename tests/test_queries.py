"""Every query with SQL against that SQL, on the smallest tables; the others run and give rows."""

import pytest

import __spark_entry__ as entry
from papyra.plans import registry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert difference(spark, con, name, QUERIES[name], ORACLES[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and max(r.ndcg_10 for r in rows) > 0.9
    assert set(entry.oracle_sql()) <= set(entry.queries())
