"""Every query against its SQL on the small tables, and the driver contract."""

import pytest

import __spark_entry__ as contract
import check
from luxframe.plans import catalog

FOLDER = "/root/testdata/sf0.001"
LONGER = "/root/testdata/sf0.01"
NEED_LONG_TRACES = ("cpa_find_all", "sql_change_points", "stream_change_points")  # no point in the short ones


@pytest.fixture(scope="module")
def database():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_agrees_with_its_sql(spark, database, name):
    outcome = check.compare(spark, database, name, FOLDER)
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    """Their results are checked by the tests of their operators."""
    folder = LONGER if name in NEED_LONG_TRACES else FOLDER
    assert contract.queries()[name](spark, folder).limit(1).count() == 1


def test_entry(spark):
    trace = contract.entry(spark)
    assert trace.columns == ["particle", "bin", "t_ms", "counts"] and trace.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
