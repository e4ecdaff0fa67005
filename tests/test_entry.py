from paths import SF001


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"rule_id", "n", "pct"}
    assert abs(sum(r.pct for r in rows) - 100.0) < 0.1


def test_every_query_has_callable_and_oracle_keys_subset(spark):
    import __spark_entry__ as e
    qs, orc = e.queries(), e.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 30
