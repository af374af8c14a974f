import __spark_entry__ as entry


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert "tokens" in df.columns
    assert df.count() > 0
