import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
