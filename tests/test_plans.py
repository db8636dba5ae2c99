"""What the plans must and must not hold."""

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from registry.queries import ORACLES, QUERIES

LAZY = [
    "conversation_rollup_doc",
    "length_histogram_doc",
    "stratified_sample",
    "first_15_messages",
    "transcript_plain",
    "transcript_authored",
    "fetch_by_ids",
    "char_stats",
    "message_flags_doc",
    "conv_gibberish",
    "conversation_flags",
    "conversation_flags_pairs_classic",
    "first_occurrence",
    "quality_metrics",
    "usability_matrix",
    "token_stats",
    "judge_summary",
    "clean_verdict",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_python_only_for_fingerprints(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "MapInPandas" not in text
    evaluated = [line for line in text.splitlines() if "ArrowEvalPython" in line]
    assert all("hash_texts" in line for line in evaluated)


def test_rule_counters_read_the_text_once(spark):
    text = plan(QUERIES["conv_gibberish"](spark, SF_DIR))
    assert text.count("FileScan") == 1


def test_first_messages_are_limited_before_the_shuffle(spark):
    text = plan(QUERIES["first_15_messages"](spark, SF_DIR))
    assert text.count("WindowGroupLimit") == 2


def test_metadata_does_not_read_the_text(spark):
    text = plan(QUERIES["conversation_metadata"](spark, SF_DIR))
    assert "text" not in text.split("ReadSchema: ")[1].split(">")[0]


def test_date_filter_reaches_the_scan(spark, make, tmp_path):
    from convq.operators.filters import date_range_filter

    make({1: ["a", "b"]}).write.parquet(str(tmp_path / "m"))
    text = plan(date_range_filter(spark.read.parquet(str(tmp_path / "m"))))
    assert "GreaterThanOrEqual(sent_at" in text and "LessThanOrEqual(sent_at" in text


@pytest.fixture
def large_input(spark, tmp_path):
    """Several files, and no table small enough to be broadcast."""
    for name in ("documents", "conversations", "labels"):
        table = spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(6)
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["conversation_flags", "message_flags", "first_occurrence", "issue_report"])
def test_text_is_read_once_and_then_narrow_rows(spark, large_input, name):
    df = QUERIES[name](spark, large_input)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert "documents.parquet" not in text  # the one read of the text wrote the features
    assert "CartesianProduct" not in text and "ArrowEvalPython" not in text


def test_dedup_branches_share_the_fingerprints(spark, large_input):
    """Whole texts and single messages come from one written table of the suspects' fingerprints."""
    df = QUERIES["conversation_flags"](spark, large_input)
    df.collect()
    scans = [line for line in plan(df).split("== Initial Plan ==")[0].splitlines() if "FileScan" in line and "fingerprints-" in line]
    assert len(scans) >= 2 and len({line.split("fingerprints-")[1][:32] for line in scans}) == 1


def test_entry_has_rows_and_every_check_belongs_to_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLES)
