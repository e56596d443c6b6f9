"""The driver contract."""

import __spark_entry__ as entry_module


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_oracle_keys_are_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
