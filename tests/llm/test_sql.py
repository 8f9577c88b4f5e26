"""Registered queries against their SQL on the smallest tables, and the contracts of the registry."""

import os

import duckdb
import pytest

import corpus_pipeline
from tesserae.llm.oracles import ORACLES
from tesserae.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    g = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    w = sorted(str(x) for x in want.project(", ".join(cols)).fetchall())
    assert g == w


def test_registry():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "source_mix", "token_output"]


def test_secret_scan_runs_no_python(spark, duck):
    from tesserae.llm import secret_scan

    plan = secret_scan.scan(spark.read.parquet(f"{DIR}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_pipeline(spark, duck):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, DIR).collect()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in out} <= ids
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert starts[0][0] == 0
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
