import __spark_entry__ as e


def test_contract(spark):
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 120
    assert e.entry(spark).count() == 150
