"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from equiloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(v) if isinstance(v, float) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = _rows(df.columns, df.collect())
    if name in registry.oracle_sql():
        cur = duck.execute(registry.oracle_sql()[name])
        columns = [x[0] for x in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == _rows(columns, cur.fetchall())
