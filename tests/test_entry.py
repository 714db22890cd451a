import __spark_entry__ as entry


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["score"] <= 1.0


def test_names():
    assert entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
