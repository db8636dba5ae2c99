"""The queries of this package that SQL can check, and brute force for the others."""

import os
import sys

import duckdb
import numpy as np
import pytest

from . import brute

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import check_oracles as check  # noqa: E402
from convq.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, result.fetchall())


def test_suffix_query(spark, documents):
    got = sorted(tuple(r) for r in QUERIES["op3_suffix_dedup"](spark, SF_DIR).collect())
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got == sorted((d, n, m, s, brute.sha(kept)) for d, n, m, s, kept in brute.suffix_dedup(rows, 400))


def test_substring_query(spark, documents):
    got = sorted(tuple(r) for r in QUERIES["op9_substring_dedup"](spark, SF_DIR).collect())
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got == sorted((d, n, m, brute.sha(kept)) for d, n, m, kept in brute.substring_dedup(rows, 13))


def test_simhash_query(spark, documents):
    rows = [(r["doc_id"], brute.fingerprint(r["text"])) for r in documents.collect()]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute.components(rows)))
    assert sorted(tuple(r) for r in QUERIES["op8_simhash"](spark, SF_DIR).collect()) == want


def test_pii_query(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in QUERIES["op7_find_pii"](spark, SF_DIR).collect():
        base = brute.base_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(",".join(base).encode())
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(base)
        assert set(base) <= set(r["spans"].split(",")) or not base


def test_nearest_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    want = brute.nearest([(r["vec_id"], np.array(r["embedding"], float)) for r in rows], 5, 50)
    got = {}
    for r in QUERIES["op6_nearest"](spark, SF_DIR).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    known = {(q, i): s for q, found in want.items() for i, s in found}
    assert all(s == pytest.approx(known[q, i], abs=1e-12) for q, f in got.items() for i, s in f if (q, i) in known)


def test_toxicity_query(spark):
    rows = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    told = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in told) / len(told) > 0.97
    assert sum(p and y for p, y in told) / sum(y for _, y in told) > 0.8
