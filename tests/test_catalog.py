"""Each query of the catalog against its SQL on the smallest data set."""

from __future__ import annotations

import duckdb
import pytest

from watchgrid import catalog

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(v[k] for k in order)) for v in values)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        assert got.count() > 0
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert {k: TYPES[v] for k, v in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())
