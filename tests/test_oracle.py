import pytest

from mnemosa.plans import registry

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, spark, sf, duck, same_rows):
    same_rows(registry.queries()[name](spark, sf), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE)))
def test_runs(name, spark, sf):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
