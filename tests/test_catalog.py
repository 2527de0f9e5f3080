"""Every screening query against its SQL on the smallest tables."""

import oracle
import pytest

from sluicegate.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert oracle.differences(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF) is None


def test_entry_registers_everything(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
