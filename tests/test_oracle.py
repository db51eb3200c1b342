"""Every registered query against its DuckDB oracle on the smallest tables,
plus the driver entry points."""

import pytest

from oracle_compare import compare

from data_paths import SF001


def test_all_registered_queries_match_oracle(spark):
    res = compare(spark, SF001, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "NO-ORACLE")}
    assert not bad, bad


def test_entry_and_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "acceptance_pct" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
