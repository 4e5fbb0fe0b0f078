import pytest

from pii_lens.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
