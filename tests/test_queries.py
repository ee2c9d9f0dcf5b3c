"""Every query with SQL against DuckDB; the others run and give rows."""

import pytest
from oracle import compare, duck

from labelforge.plans import records, registry, runs  # noqa: F401


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in registry.SQL:
        assert compare(spark, con, registry.QUERIES[name], registry.SQL[name], sf_dir) == ""
    else:
        assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["isbn13", "field", "path", "votes", "tier"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
