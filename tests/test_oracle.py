"""Every query that has SQL gives the same rows as DuckDB over the same tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lumenote.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    rows = Counter(map(tuple, got.select(*columns).collect()))
    assert rows == Counter(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())
