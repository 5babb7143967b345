"""Driver contract: entry, registry and oracles."""

import __spark_entry__ as E


def test_registry_shapes():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 90 and set(sql) <= set(qs)
    assert "journey_score" in sql


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and {"journey_id", "grade", "overall_score"} <= set(df.columns)
    assert all(0.0 <= r.overall_score <= 100.0 for r in rows)
