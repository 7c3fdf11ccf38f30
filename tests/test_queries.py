"""The driver's contract: the smoke query, and SQL for no query that isn't there."""

import __spark_entry__ as entry
from folioscope.plans import catalog


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())
