import pytest

import oracle
from weftgraph.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, con, data, name):
    assert oracle.differences(spark, con, catalogue.QUERIES[name], catalogue.ORACLE[name], data) == ([], [])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE.keys()))
def test_query_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0 or name == "forbidden_phrases"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
