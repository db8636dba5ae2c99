"""Joins of messages when some conversations are very large."""

import pytest
from pyspark.sql import functions as F

from convq.operators import joins


@pytest.fixture(scope="module")
def crowded(make):
    """Two large conversations, many small ones, and rows without an id."""
    m = make({1: ["a"] * 400, 2: ["b"] * 300, **{i: ["x", "y"] for i in range(10, 60)}})
    return m.unionByName(m.limit(3).withColumn("conversation_id", F.lit(None).cast("bigint"))).repartition(4)


def rows(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=repr)


def test_heavy_ids_are_counted_and_bounded(crowded):
    ids = lambda **kw: sorted(r[0] for r in joins.heavy_ids(crowded, **kw).collect())
    assert ids(least=100) == [1, 2] and ids(least=350) == [1] and ids(least=2, most=2) == [1, 2] and ids() == []


@pytest.mark.parametrize("least", [100, 2, 10**9])
def test_heavy_ids_change_no_result(spark, crowded, least):
    heavy = joins.heavy_ids(crowded, least)
    ids = spark.createDataFrame([(1,), (1,), (11,), (12,), (99,), (None,)], "conversation_id bigint")
    assert rows(joins.fetch_by_ids(crowded, ids, heavy)) == rows(joins.fetch_by_ids(crowded, ids))
    once = ids.distinct().withColumn("share", F.lit(0.5))
    assert rows(joins.sampled_messages(crowded, once, heavy)) == rows(joins.sampled_messages(crowded, once))
    got, want = (joins.metadata_messages(once, crowded, h) for h in (heavy, None))
    assert got.columns == want.columns and rows(got) == rows(want)


def test_heavy_messages_are_not_shuffled(spark, crowded, tmp_path):
    crowded.write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    heavy = joins.heavy_ids(m, 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.createDataFrame([(1,), (2,), (11,), (12,)], "conversation_id bigint")
        got = joins.fetch_by_ids(m, ids, heavy)
        assert got.count() == 704
        text = got._jdf.queryExecution().executedPlan().toString()
        by_union = text.split("Union")[1]
        assert "BroadcastHashJoin" in by_union and "SortMergeJoin" in by_union
        light = m.join(F.broadcast(heavy), "conversation_id", "left_anti")
        most = light.groupBy("conversation_id").count().agg(F.max("count")).first()[0]
        assert most == 3  # what the shuffle deals by id; rows without an id are the largest group left
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
