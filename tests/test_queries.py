"""Every registered query with SQL agrees with DuckDB on the same tables: columns, rows and values."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from quillstack.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p if Path(p).is_file() else p + '/*.parquet'}')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", registry.NAMES)
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.columns
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(rows, got.columns) == normal(want.fetchall(), want.columns)
    assert rows or name in ("page_range_cover",)


def test_every_name_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
