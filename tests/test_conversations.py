import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from convq import schema as s
from convq.functions import fingerprint as fp
from convq.functions.rules import CLASSIC, OPTIMIZED
from convq.operators import duplicates as dup
from convq.operators import quality, reports
from convq.sources.workspace import stored
from spec import corpus

CASES = {
    1: ["just one message here"],
    2: ["ab", "cd"],
    3: ["message number %d of many" % i for i in range(51)],
    4: ["thanks a lot", "Thanks a lot ", "hm okay then", "THANKS A LOT"],
    5: ["yes", "yes", "yes", "a longer answer here"],
    6: ["hello my friend", "zzzzzzzzzz", "how are you", "qwrtpsd fghjkl"],
    7: ["fine words %d" % i for i in range(7)] + ["bad \x07 one", "bad \x07 two", "bad \x07 three"],
    8: ["good words", "bad \x07 one", "bad \x07 two", "more good words", "and more words"],
    9: ["go to hell"],
    10: ["how is the weather", "it is very sunny"],
    11: ["how is the weather", " It is very SUNNY"],
    12: ["it is very sunny", "how is the weather"],
    13: ["it is very sunny"],
    14: ["how is the", "weather it is very sunny"],
    15: [None, "a real text here", None, "and another text"],
    16: ["", "   ", "\n"],
    17: ["  ", "a real text here", "", "and another text", "\t"],
    18: ["ab", "  " * 10, "cde"],
    19: ["a real text here", "  and another text"],
    20: ["", ""],
    21: ["click here for 50% off", "no thank you very much"],
    22: ["日本語 の テキスト", "日本語 の テキスト です", "hello there friend"],
}


def flags_of(df, profile, **kw):
    rows = quality.conversation_flags(df, profile, **kw).collect()
    return {r.conversation_id: {n: r[n] for n in s.ISSUES} for r in rows}


@pytest.mark.parametrize("profile", [OPTIMIZED, CLASSIC])
def test_hand_written_conversations(make, profile):
    got, want = flags_of(make(CASES), profile), corpus(CASES, profile.classic)
    for cid in CASES:
        assert got[cid] == want[cid], (cid, CASES[cid])


def test_expected_values_of_single_cases(make):
    got = flags_of(make(CASES), OPTIMIZED)
    assert got[1]["single_turn"] and got[2]["too_short"] and got[2]["empty"] and got[3]["too_long"]
    assert got[4]["repetitive_spam"] and not got[5]["repetitive_spam"]
    assert not got[6]["gibberish"]  # exactly half
    assert not got[7]["encoding_issues"] and got[8]["encoding_issues"]  # 3 of 10, 2 of 5
    assert not got[9]["offensive"]  # skipped: single turn
    assert flags_of(make({9: CASES[9]}), CLASSIC)[9]["offensive"]
    assert not got[10]["duplicate"] and got[11]["duplicate"] and got[14]["duplicate"]
    assert got[13]["duplicate"]  # equals an earlier message
    assert not flags_of(make(CASES), OPTIMIZED, dedup_scope="conversation")[13]["duplicate"]


def random_corpus(seed, n=120):
    rng = random.Random(seed)
    pieces = ["alpha beta", "gamma", "delta eps", "ok", "", " ", "\t\n", "Go to hell", "zz", "alpha", "beta gamma"]
    return {
        i: [
            rng.choice(["", " ", "\n"]) + " ".join(rng.choices(pieces, k=rng.randint(0, 2))) + rng.choice(["", "  "])
            for _ in range(rng.randint(1, 6))
        ]
        for i in range(n)
    }


@pytest.mark.parametrize("profile", [OPTIMIZED, CLASSIC])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpus_equals_a_sequential_loop(make, profile, seed):
    conversations = random_corpus(seed)
    want = corpus(conversations, profile.classic)
    assert sum(f["duplicate"] for f in want.values()) > 10
    assert flags_of(make(conversations), profile) == want


def test_flags_do_not_depend_on_partitions_or_row_order(make):
    conversations = random_corpus(3, 60)
    want = flags_of(make(conversations), OPTIMIZED)
    for partitions, reverse in [(1, True), (4, False), (33, True)]:
        assert flags_of(make(conversations, partitions, reverse), OPTIMIZED) == want


@pytest.mark.parametrize("step", [0, 7, 61])
def test_fingerprint_of_parts_equals_fingerprint_of_the_whole(make, step):
    conversations = random_corpus(4, 80)
    conversations[500] = ["", "x" * 5000, " ", "yé\U0001f600" * 3000, "end  "]
    df = make(conversations, 5, True, dt.timedelta(seconds=step))
    for profile in (OPTIMIZED, CLASSIC):
        parts = dup.conversation_fingerprints(dup.instants(dup.message_fingerprints(df, profile)))
        rows = parts.select("conversation_id", fp.core().alias("c")).collect()
        assert len(rows) == len(conversations)
        for r in rows:
            texts = conversations[r.conversation_id]
            whole = " ".join(texts if profile.classic else [t.strip() for t in texts]).strip()
            assert (list(r.c.h), list(r.c.w)) == tuple(fp.hash_text(whole.lower()))
            assert r.c.n == len(whole)


def test_different_texts_have_different_fingerprints():
    texts = ["", "a", "b", "ab", "ba", "\x00", "\x00\x00", "a" * 2048, "a" * 2049, "a" * 4096, "b" + "a" * 4095]
    assert len({str(fp.hash_text(t)) for t in texts}) == len(texts)


def test_first_occurrence_equals_a_running_set(make):
    conversations = random_corpus(5, 60)
    m = make(conversations)
    features = stored(quality.message_features(m, CLASSIC), "features")
    wholes = stored(quality.gate_counters(features), "wholes")
    got = {
        (r.conversation_id, r.kind, r.message_id): r.duplicate
        for r in dup.first_occurrence(features, wholes, m, CLASSIC).collect()
    }
    seen, want = set(), {}
    for cid in sorted(conversations):
        texts = conversations[cid]
        entries = [((cid, 0, None), " ".join(texts))]
        entries += [((cid, 1, cid * 1000 + i), t) for i, t in enumerate(texts)]
        for place, text in entries:
            want[place] = text.strip().lower() in seen
            seen.add(text.strip().lower())
    assert got == want


def test_one_text_may_make_up_most_of_the_corpus(spark, make):
    conversations = {i: ["the very same words", "and the same answer"] for i in range(400)}
    conversations |= {1000 + i: [f"own words {i}", f"own answer {i}"] for i in range(200)}
    flags = quality.conversation_flags(make(conversations, 8))
    assert flags.filter("duplicate").count() == 399


def test_one_conversation_may_hold_most_messages(make):
    conversations = {1: [f"message number {i % 700}" for i in range(3000)], 2: ["short talk", "indeed it is"]}
    got = flags_of(make(conversations, 6, step=dt.timedelta(milliseconds=500)), OPTIMIZED)
    assert got[1]["too_long"] and got[1]["repetitive_spam"] and not got[2]["too_long"]


def test_report_invariants(make):
    flags = quality.conversation_flags(make(CASES)).cache()
    metrics = reports.quality_metrics(flags).first()
    segments = reports.stratified_metrics(flags)
    assert segments.agg(F.sum("total_conversations")).first()[0] == metrics.total_conversations == len(CASES)
    assert metrics.usable <= metrics.total_conversations
    sums = reports.issue_flag_counts(flags).groupBy("issue").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in sums} == {len(CASES)} and len(sums) == len(s.ISSUES)
    ids = quality.usable_conversations(flags)
    assert ids.count() == metrics.usable
    assert reports.usability_matrix(segments).count() == 4
    assert reports.top_issues(reports.quality_metrics(flags)).count() == 5


def test_empty_input_gives_zeros(make):
    flags = quality.conversation_flags(make({1: ["x"]}).limit(0))
    metrics = reports.quality_metrics(flags)
    row = metrics.first()
    assert row.total_conversations == 0 and row.total_messages == 0
    assert {r.percentage for r in reports.issue_report(metrics).collect()} == {0.0}
    assert reports.usable_percentage(metrics).first().usable_pct_reported == 0.0
    assert reports.projection(metrics, 0.001).first().estimated_total_conversations == 0
    assert reports.usability_matrix(reports.stratified_metrics(flags)).count() == 4


def test_reported_share_can_go_below_zero(make):
    metrics = reports.quality_metrics(quality.conversation_flags(make({1: ["", ""], 2: ["a", "b"]})))
    row = reports.usable_percentage(metrics).first()
    assert row.usable_pct_reported < 0 and row.usable_pct_ids == 0
