import pytest

from melisma.plans import registry
from tests.oracle import SF, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    names, got = rows_of(registry.QUERIES[name](spark, SF))
    expected_names, expected = sql_rows(registry.ORACLES[name])
    assert names == expected_names
    assert got == expected
    assert got


def test_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
