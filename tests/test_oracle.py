"""Every query with a DuckDB twin must agree with it on sf0.001 (columns,
types, rows as a multiset; floats compared to 6 decimals)."""

from __future__ import annotations

import pytest

from tessera.plans.registry import entries
from tools.oracle_check import compare

SQL_QUERIES = sorted(n for n, e in entries().items() if e.sql)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_matches_duckdb(spark, duck, sf_dir, name):
    e = entries()[name]
    res = compare(spark, duck, name, e.fn, e.sql, sf_dir)
    assert res["status"] in ("OK", "APPROX"), res
