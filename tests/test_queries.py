"""Every array query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tesserae.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = ["part", "orders", "customer", "events", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    g = sorted(tuple(r[c] for c in cols) for r in got.collect())
    w = sorted(want.project(", ".join(cols)).fetchall())
    assert len(g) == len(w)
    assert all(x == y or x == pytest.approx(y, abs=2e-6) for x, y in zip(g, w))
