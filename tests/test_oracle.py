"""Every registered query of the library against DuckDB; llm has its own tests."""

import pytest

from tests import oracle
from tidemark import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert not oracle.difference(plans.QUERIES[name](spark, sf_dir), con, plans.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    """What the rows hold is compared with plain versions in test_matching."""
    df = plans.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
