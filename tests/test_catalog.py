import __spark_entry__ as entry
from lexmill.plans import catalog


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) >= 35
    assert entry.entry(spark).count() > 0
