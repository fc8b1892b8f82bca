"""Every catalogue query against its SQL, on the smallest test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodestrata.plans import catalog, catalog_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 4) + 0.0
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalog_sql.SQL:
        assert got
        return
    rel = db.sql(catalog_sql.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
