import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from convq import schema as s
from convq.operators import filters as f
from convq.operators import joins, rollup, sampling, transcripts
from convq.sources import messages as msg

D = dt.datetime


def test_time_bucket_edges(spark):
    cases = {
        D(2023, 6, 30, 23): "unknown",
        D(2023, 7, 1): "2023-Q3",
        D(2023, 9, 30, 12): "2023-Q3",
        D(2024, 2, 29, 1): "2024-Q1",
        D(2024, 12, 31, 23, 59): "2024-Q4",
        D(2025, 1, 31): "2025-Q1",
        D(2025, 1, 31, 0, 1): "2025-Q1",
        D(2025, 2, 1): "unknown",
    }
    df = spark.createDataFrame([(k,) for k in cases], "sent_at timestamp")
    rows = df.select(
        "sent_at",
        f.time_bucket(F.col("sent_at")).alias("b"),
        f.sampling_bucket(F.col("sent_at")).alias("sb"),
        f.in_date_range(F.col("sent_at")).alias("inside"),
        f.in_date_range(F.col("sent_at"), end_inclusive_day=True).alias("whole"),
    ).collect()
    for r in rows:
        assert r.b == cases[r.sent_at], r
    by = {r.sent_at: r for r in rows}
    assert by[D(2023, 9, 30, 12)].sb is None and by[D(2023, 7, 1)].sb == "2023-Q3"
    assert by[D(2025, 1, 31)].inside and not by[D(2025, 1, 31, 0, 1)].inside
    assert by[D(2025, 1, 31, 0, 1)].whole and not by[D(2025, 2, 1)].whole


def test_length_classes(spark):
    cases = {0: "unknown", 1: "one_off", 2: "one_off", 3: "short", 5: "short", 6: "medium", 20: "medium"}
    cases |= {21: "long", 999: "long", 1000: "long", 10**7: "long"}
    df = spark.createDataFrame([(k,) for k in cases], "n bigint")
    got = {r.n: r.c for r in df.select("n", f.length_category(F.col("n")).alias("c")).collect()}
    assert got == cases


def test_bucket_bounds_equal_the_fixed_table(spark):
    df = spark.createDataFrame([(D(y, m, 15),) for y in (2023, 2024, 2025) for m in range(1, 13)], "sent_at timestamp")
    got = {(r.time_bucket, str(r.start_date), str(r.end_date)) for r in f.bucket_bounds(df).collect()}
    assert got == set(s.TIME_BUCKETS)


def test_message_view_maps_names_and_nulls(spark):
    raw = spark.createDataFrame([("c1", None, D(2024, 1, 1), 5)], "ConvId string, BODY string, SENT_AT timestamp, other int")
    view = msg.message_view(raw, {"conversation_id": "convid", "text": "body"})
    assert view.columns == ["conversation_id", "text", "sent_at"]
    assert view.first().text == ""


def test_two_sided_needs_both_sides_in_range(messages_at):
    m = messages_at(
        [
            (1, D(2024, 1, 1), "HUMAN_TO_AI"), (1, D(2024, 1, 2), "AI_TO_HUMAN"),
            (2, D(2024, 1, 1), "HUMAN_TO_AI"), (2, D(2025, 3, 1), "AI_TO_HUMAN"),
            (3, D(2024, 1, 1), "HUMAN_TO_AI"), (3, D(2024, 1, 1), "SYSTEM"),
        ]
    )
    assert [r.conversation_id for r in rollup.conversation_metadata(m).collect()] == [1]
    assert joins.in_group_having(m).count() == 2


def test_histogram_with_one_length_and_with_none(messages_at):
    m = messages_at([(1, D(2024, 1, 1), "HUMAN_TO_AI"), (1, D(2024, 1, 2), "AI_TO_HUMAN")])
    rows = rollup.length_histogram(m).collect()
    assert len(rows) == 50 and {r.bin: r.n_conversations for r in rows if r.n_conversations} == {25: 1}
    assert rollup.length_histogram(m.limit(0)).count() == 0


def test_lowest_per_group_is_exact(spark):
    rows = [(g, i, hashlib.md5(f"{g}:{i}".encode()).hexdigest()) for g, n in (("hot", 9000), ("cold", 7)) for i in range(n)]
    rows += [("ties", i, "abc" + "0" * 29) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, conversation_id int, o string")
    got = {(r.g, r.conversation_id) for r in sampling.lowest_per_group(df, ["g"], "o", 20).collect()}
    want = set()
    for g in ("hot", "cold", "ties"):
        want |= {(g, i) for _, i in sorted((o, i) for gg, i, o in rows if gg == g)[:20]}
    assert got == want


def test_stratified_sample_counts_inside_the_bucket(messages_at):
    sides = ["HUMAN_TO_AI", "AI_TO_HUMAN"]
    straddling = [(7, D(2023, 9, 29, h), sides[h % 2]) for h in range(3)] + [(7, D(2023, 10, 1, h), sides[h % 2]) for h in range(6)]
    late = [(8, D(2023, 9, 30, h), sides[h % 2]) for h in range(1, 5)]
    got = {tuple(r) for r in sampling.stratified_sample(messages_at(straddling + late), 28).collect()}
    assert got == {(7, "2023-Q3", "short"), (7, "2023-Q4", "medium")}


def test_samples_repeat_and_follow_the_seed(make):
    m = make({i: ["one message", "two messages"] for i in range(300)})
    ids = lambda df: sorted(r.conversation_id for r in df.collect())
    a = ids(sampling.random_conversations(m, 20))
    assert a == ids(sampling.random_conversations(m.repartition(7), 20)) and len(set(a)) == 20
    assert a != ids(sampling.random_conversations(m, 20, seed=1))
    share = len(ids(sampling.percent_sample(m, 0.3)))
    assert 50 < share < 130 and len(ids(sampling.percent_sample(m, 1.0))) == 300


def test_oversize_conversations_come_whole_as_messages(make):
    m = make({1: ["x" * 50] * 4, 2: ["short", "talk"]})
    assert [r.text for r in transcripts.oversize_messages(m, 100).collect()] == ["x" * 50] * 4
    whole = {r.conversation_id: r.combined_text for r in transcripts.transcript_plain(m).collect()}
    assert whole == {1: " ".join(["x" * 50] * 4), 2: "short talk"}
    parts = {}
    for r in transcripts.transcript_plain(m, 60).orderBy("part").collect():
        parts[r.conversation_id] = parts.get(r.conversation_id, "") + r.combined_text
    assert parts == whole
    assert transcripts.transcript_plain(m, 60).count() > 2


def test_authored_transcript_keeps_fifteen_lines(make):
    m = make({1: [f"line {i}" for i in range(40)], 2: [None, "b"]})
    got = {r.conversation_id: r.full_conversation for r in transcripts.transcript_authored(m, 15).collect()}
    assert got[1].split("\n") == [f"{'AI_TO_HUMAN' if i % 2 else 'HUMAN_TO_AI'}: line {i}" for i in range(15)]
    assert got[2] == "HUMAN_TO_AI: \nAI_TO_HUMAN: b"


def test_funnel_adds_up(make):
    m = make({1: ["x"], 2: ["1234567890" * 9], 3: ["a readable text with letters and more letters in it"]})
    t = transcripts.transcript_authored(m)
    r = f.prefilter_funnel(t).first()
    assert (r.initial, r.removed_short, r.removed_gibberish, r["final"]) == (3, 1, 1, 1)
    assert f.prefilter(t).count() == r["final"]
    assert f.alpha_ratio_filter(t.select(F.lit("").alias("full_conversation")), "full_conversation").count() == 0


@pytest.mark.parametrize("view", ["conv", "doc", "pairs"])
def test_segments_add_up(spark, view):
    from conftest import SF_DIR
    from registry.queries import VIEW

    m = VIEW[view](spark, SF_DIR)
    total = rollup.two_sided_conversations(m).count()
    assert rollup.totals_by_class_and_quarter(m).agg(F.sum("n_conversations")).first()[0] == total
    assert rollup.length_histogram(m).agg(F.sum("n_conversations")).first()[0] == total


def test_messages_without_a_conversation_are_set_aside_everywhere(spark, make):
    from convq.operators import quality

    m = make({1: ["hello there friend", "fine thanks a lot"], 2: ["one more talk", "with an answer"]})
    lost = m.limit(1).withColumn("conversation_id", F.lit(None).cast("bigint"))
    both = m.unionByName(lost)
    assert rollup.unassigned_messages(both).first().asDict() == {"n_messages": 5, "n_unassigned": 1}
    for table in (
        rollup.conversation_rollup(both), quality.conversation_flags(both), transcripts.transcript_plain(both),
        sampling.random_conversations(both, 10), sampling.percent_sample(both, 1.0), transcripts.transcript_authored(both),
    ):
        assert sorted(r.conversation_id for r in table.collect()) == [1, 2]


def test_jdbc_reads_are_split(spark):
    import pytest

    from convq.sources.messages import scan

    with pytest.raises(ValueError, match="partitionColumn"):
        scan(spark, format="jdbc", url="jdbc:none", dbtable="messages")
