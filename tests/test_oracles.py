"""A cross-section of the registered queries against their SQL on the smallest data.

All of them: ``python tools/check_oracles.py``.
"""

import os
import sys

import pytest

from conftest import ROOT, SF_DIR

sys.path.insert(0, os.path.join(ROOT, "tools"))

import check_oracles as check  # noqa: E402
from registry.queries import ORACLES, QUERIES  # noqa: E402

NAMES = [
    "message_view",
    "incremental_pull",
    "store_status",
    "stratified_sample",
    "length_histogram_doc",
    "length_distribution_conv",
    "quarterly_volume",
    "transcript_stripped",
    "prefilter_funnel",
    "char_stats",
    "message_flags_doc",
    "message_flags_pairs_classic",
    "conversation_flags_doc",
    "conversation_flags",
    "conversation_flags_pairs_classic",
    "first_occurrence",
    "stratified_metrics",
    "usability_matrix",
    "projection",
    "cost_summary",
    "clean_verdict",
    "judge_summary",
    "stream_message_flags",
    "materialize_messages",
    "read_stored",
    "random_conversations",
    "approx_distinct_conversations",
    "transcript_plain",
    "usable_ids_read_back",
    "usable_all_read_back",
    "count_tokens",
    "token_rows_read_back",
    "prompt_column",
    "judge_scores",
    "judge_errors",
    "stored_run",
    "stream_dedup",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, result.fetchall())
