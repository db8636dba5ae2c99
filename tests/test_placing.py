"""Transcripts, filters and duplicate checks of conversations of any shape."""

import datetime as dt
import random

import pytest
from conftest import BASE, SCHEMA
from pyspark.sql import functions as F

from convq.functions.rules import CLASSIC, OPTIMIZED
from convq.operators import duplicates as dup
from convq.operators import filters as f
from convq.operators import placing, quality, transcripts
from convq.sources.workspace import stored


def crowd(n, at=lambda i: BASE, number=lambda i: i, text=lambda i: f"text {i}"):
    """One conversation whose messages crowd together, and a small one."""
    rows = [(1, number(i), text(i), "HUMAN_TO_AI", at(i)) for i in range(n)]
    random.Random(1).shuffle(rows)
    return rows + [(2, 1, "hello there", "HUMAN_TO_AI", BASE), (2, 2, None, "AI_TO_HUMAN", None)]


SHAPES = {
    "one instant": {},
    "no time": {"at": lambda i: None},
    "sparse ids": {"number": lambda i: (i - 250) * 2**52 // 3},
    "one second": {"at": lambda i: BASE + dt.timedelta(microseconds=i)},
    "hours": {"at": lambda i: BASE + dt.timedelta(minutes=7 * i)},
    "one id": {"number": lambda i: 7},
    "no id": {"number": lambda i: None, "at": lambda i: None},
    "one text": {"number": lambda i: None, "at": lambda i: None, "text": lambda i: "same"},
}


def in_order(rows, marks):
    """Texts of conversation 1 by time, id, mark and text, nulls first."""
    key = lambda r: (r[4] is not None, r[4] or BASE, r[1] is not None, r[1] or 0, marks[r[2]], r[2])
    return [r[2] for r in sorted((r for r in rows if r[0] == 1), key=key)]


@pytest.mark.parametrize("shape", SHAPES)
def test_small_tasks_put_large_conversations_in_order(spark, shape):
    rows = crowd(500, **SHAPES[shape])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    marks = {r.text: r.mark for r in df.select("text", placing.mark("text").alias("mark")).distinct().collect()}
    parts = transcripts.transcript_plain(df, 64, bucket=20).orderBy("conversation_id", "part").collect()
    assert "".join(r.combined_text for r in parts if r.conversation_id == 1) == " ".join(in_order(rows, marks))
    assert "".join(r.combined_text for r in parts if r.conversation_id == 2) == " hello there"
    assert max(len(r.combined_text) for r in parts) <= 64 + 1 + 8
    plain = transcripts.transcript_plain(df, 64).orderBy("conversation_id", "part").collect()
    assert plain == parts


@pytest.mark.parametrize("shape", SHAPES)
def test_levels_bound_what_is_ordered_at_once(spark, shape):
    df = spark.createDataFrame(crowd(500, **SHAPES[shape]), SCHEMA).withColumn("mark", placing.mark("text"))
    names = placing.levels_needed(df, 20)
    groups = placing.with_levels(df, names).groupBy("conversation_id", *names).count()
    most = groups.agg(F.max("count")).first()[0]
    assert most <= 20 or (shape == "one text" and names == list(placing.LEVELS))
    assert placing.levels_needed(df, 1000) == []


def test_a_long_conversation_takes_nothing_from_the_others(make):
    m = make({1: ["x" * 50] * 40, 2: ["a readable text of some length", "and an answer to it that is long"], 3: ["0" * 60]})
    counts = transcripts.authored_counts(m)
    kept = f.prefilter(counts)
    assert {r.conversation_id for r in kept.collect()} == {1, 2}
    whole = transcripts.whole(transcripts.parts_of(m, kept, part_chars=100), cell_parts=4)
    texts = {r.conversation_id: r.full_conversation for r in whole.collect()}
    assert texts[1] is None and texts[2].startswith("HUMAN_TO_AI: a readable") and set(texts) == {1, 2}


def test_a_text_too_long_for_a_prompt_is_an_error_row(spark):
    from convq.functions import judge

    asked = spark.createDataFrame([(1, None), (2, "short")], "conversation_id bigint, full_conversation string")
    for batched in (False, True):
        scorer = (lambda qs: ["{}" for _ in qs]) if batched else (lambda q: "{}")
        got = {r.conversation_id: (r.response, r.error) for r in judge.judge_responses(asked, scorer, batched=batched).collect()}
        assert got == {1: (None, judge.TOO_LONG), 2: ("{}", None)}


@pytest.mark.parametrize("n", [None, 2])
def test_counts_equal_those_of_the_texts(make, n):
    m = make({1: ["one", None, "trois é 3"], 2: [""], 3: ["...", "many words in a row"]})
    texts = {r.conversation_id: r.full_conversation for r in transcripts.transcript_authored(m, n).collect()}
    for r in transcripts.authored_counts(m, n).collect():
        text = texts[r.conversation_id]
        assert (r.n_chars, r.n_letters) == (len(text), sum(c.isalpha() for c in text))


def test_the_funnel_collects_no_text(make):
    m = make({1: ["one", "two"]})
    funnel = f.prefilter_funnel(transcripts.authored_counts(m))
    assert "collect_list" not in funnel._jdf.queryExecution().toString()


@pytest.mark.parametrize("profile", [OPTIMIZED, CLASSIC])
def test_signatures_add_up(make, profile):
    texts = ["one two", "  three four ", "", "ÀÉ one", "  ", "two\tthree"]
    df = make({1: texts, 2: [" ".join(texts)], 3: list(reversed(texts)), 4: ["one", "two"]})
    sums = quality.message_features(df, profile).groupBy("conversation_id").agg(dup.signature_sum())
    got = {r.conversation_id: tuple(r)[1:] for r in sums.collect()}
    assert got[1] == got[2] == got[3] != got[4]


def without_python(df):
    return "Python" not in df._jdf.queryExecution().toString()


def test_only_suspects_are_hashed(make, monkeypatch):
    plain = {i: [f"words of {i} here", f"answer number {i} there"] for i in range(30)}
    read = []
    monkeypatch.setattr(dup, "_prints", lambda messages, ids, profile, f=dup._prints: read.append(ids.count()) or f(messages, ids, profile))
    for profile in (OPTIMIZED, CLASSIC):
        flags = quality.conversation_flags(make(plain), profile)
        assert not read and without_python(flags) and flags.filter("duplicate").count() == 0
    # the same words in another order, and one real copy that is cut in another way
    again = plain | {50: ["answer number 3 there", "words of 3 here"], 60: ["words of", "4 here answer number 4 there"]}
    flags = quality.conversation_flags(make(again), OPTIMIZED)
    assert [r.conversation_id for r in flags.filter("duplicate").collect()] == [60]
    assert read == [4]


def test_white_space_tells_texts_apart(make):
    """Equal words, other white space: suspects that are no copies."""
    pairs = {1: ["some words here", "more of them"], 2: ["some  words here", "more of them"], 3: ["some words here more", "of them"]}
    flags = {r.conversation_id: r.duplicate for r in quality.conversation_flags(make(pairs)).collect()}
    assert flags == {1: False, 2: False, 3: True}


def test_crowded_conversations_are_compared_in_order(spark, monkeypatch):
    monkeypatch.setattr(placing, "levels_needed", lambda rows, bucket=9, f=placing.levels_needed: f(rows, 9))
    rows = crowd(120, at=lambda i: None)
    copy = [(3, *r[1:]) for r in rows if r[0] == 1]
    swapped = [(4, r[1], f"text {(r[1] + 1) % 120}", *r[3:]) for r in rows if r[0] == 1]
    df = spark.createDataFrame(rows + copy + swapped, SCHEMA)
    flags = quality.conversation_flags(df, dedup_scope="conversation")
    assert [r.conversation_id for r in flags.filter("duplicate").collect()] == [3]


def test_messages_without_ids_are_marked_one_by_one(spark):
    rows = [(1, None, "the same words", "HUMAN_TO_AI", None)] * 3 + [(1, None, "other words", "HUMAN_TO_AI", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.duplicate for r in dup.message_duplicates(df).collect()) == [False, False, True, True]
    features = stored(quality.message_features(df), "features")
    got = dup.first_occurrence(features, stored(quality.gate_counters(features), "wholes"), df).collect()
    assert sorted((r.kind, r.duplicate) for r in got) == [(0, False), (1, False), (1, False), (1, True), (1, True)]


def test_sketches_of_days_answer_any_range(spark):
    from convq.operators import rollup

    rows = [(i % 700, i, "x", "HUMAN_TO_AI", BASE + dt.timedelta(days=i % 40)) for i in range(3000)]
    sketches = stored(rollup.daily_sketches(spark.createDataFrame([*rows, (None, 1, "x", "y", BASE), (5, 1, "x", "y", None)], SCHEMA)), "sketches")
    day = lambda k: BASE.date() + dt.timedelta(days=k)
    wanted = [(day(0), day(39)), (day(3), day(3)), (day(50), day(60))]
    got = {(r[0], r[1]): r[2] for r in rollup.sketched_conversations(sketches, spark.createDataFrame(wanted, "first_day date, last_day date")).collect()}
    for first, last in wanted:
        exact = len({r[0] for r in rows if first <= r[4].date() <= last})
        assert abs(got[first, last] - exact) <= 3 * rollup.sketch_error() * exact
