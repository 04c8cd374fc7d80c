"""Streaming parity with batch, the driver contract, and the oracle differential."""

import math
import os
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sparkpairs.functions.constants import PRODUCTION_ERROR_CONFIG
from sparkpairs.operators.errors import insert_errors
from sparkpairs.plans.oracle import oracle_sql
from sparkpairs.plans.registry import QUERIES
from sparkpairs.streaming.inject import stream_insert_errors

SMALL = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_out):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "text")
    src = f"{tmp_out}/in"
    docs.repartition(3).write.parquet(src)
    q = stream_insert_errors(spark, src, docs.schema, f"{tmp_out}/out", name=f"t{uuid.uuid4().hex}",
                             config=PRODUCTION_ERROR_CONFIG, max_files_per_trigger=1)
    q.awaitTermination(300)
    streamed = {(r.doc_id, r.original) for r in spark.read.parquet(f"{tmp_out}/out").collect()}
    batch = {(r.doc_id, r.original) for r in insert_errors(docs, "text", ["doc_id"], PRODUCTION_ERROR_CONFIG, 42).collect()}
    assert streamed == batch


def test_entry_contract(spark):
    df = E.entry(spark)
    # the flagship is the whole corpus build: error pairs and named corpora, in one order per split
    assert df.columns == ["split", "source", "original", "corrected", "rank"]
    assert {r.split for r in df.select("split").distinct().collect()} == {"train", "test"}
    assert df.count() > 0
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ["documents", "pages", "benchmark", "labels", "conversations", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle_differential(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    described = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {oracle_sql()[name]}").fetchall()}
    for f in df.schema.fields:
        assert DUCK_TYPES.get(f.dataType.simpleString()) == described[f.name], f.name
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    res = duck.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted(repr(tuple(_norm(row[i]) for i in idx)) for row in res.fetchall())
    assert got == want
