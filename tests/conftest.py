from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SMOKE


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    from tessera.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con
