"""The driver's contract."""

import __spark_entry__ as entry


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["id", "fan_in", "fan_out", "coupling", "blast_radius", "risk_level"] and found.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
