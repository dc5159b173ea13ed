"""Every query that has SQL gives what the SQL gives; the others run."""

import pytest

from docgrain.plans import catalog
from tests.oracle import assert_same, connect

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert_same(catalog.queries()[name](spark, sf).toPandas(), connect(sf).execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).columns == ["query_id", "chunk_id", "doc_source", "score"]
