"""Metrics over pulls, and judge runs that go on."""

import os
import random

import pytest

from convq.functions import judge
from convq.functions.rules import CLASSIC, OPTIMIZED
from convq.operators import quality, reports
from convq.plans.incremental import MetricsStore
from convq.plans.judge_run import JudgeRun, Journal
from test_conversations import random_corpus


def rows(df):
    return sorted(df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("profile", [OPTIMIZED, CLASSIC])
def test_pulls_equal_one_run(spark, make, tmp_path, profile):
    corpus = random_corpus(11, 40)
    corpus |= {100 + i: corpus[i] for i in range(0, 40, 5)}
    ids = sorted(corpus)
    random.Random(2).shuffle(ids)
    kept = MetricsStore(spark, str(tmp_path / "metrics"), profile)
    with pytest.raises(ValueError, match="nothing stored"):
        kept.quality_metrics()
    seen = {}
    for k in range(3):
        part = {i: corpus[i] for i in ids[k::3]}
        seen |= part
        for _ in range(1 + k % 2):  # adding a finished pull again changes nothing
            kept.add(make(part), f"pull{k}")
    flags = quality.conversation_flags(make(seen), profile).cache()
    assert rows(kept.conversation_flags()) == rows(flags)
    assert rows(kept.quality_metrics()) == rows(reports.quality_metrics(flags))
    assert rows(kept.stratified_metrics()) == rows(reports.stratified_metrics(flags))
    assert flags.filter("duplicate").count() > 3


def test_an_unfinished_pull_does_not_count(spark, make, tmp_path):
    first, second = {1: ["some words here", "and more"]}, {2: ["some words here", "and more"], 3: ["x", "y"]}
    kept = MetricsStore(spark, str(tmp_path))
    kept.add(make(first), "a")
    make(second).write.parquet(str(tmp_path / "flags" / "pull=b"))  # died half way
    assert kept.quality_metrics().first().total_conversations == 1
    kept.add(make(second), "b")
    assert kept.quality_metrics().first().total_conversations == 3 and kept.quality_metrics().first().duplicate == 1


def transcripts_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "conversation_id bigint, full_conversation string").repartition(3)


def counting(folder, fail=lambda text: False):
    """A scorer that leaves a line per call, in a file per process."""

    def score(question):
        text = question[len(judge.PROMPT_HEAD) : -len(judge.PROMPT_TAIL)]
        with open(os.path.join(folder, f"calls-{os.getpid()}"), "a") as out:
            out.write(text + "\n")
        if fail(text):
            raise ValueError("no answer")
        return '{"quality": 3}'

    return score


def calls(folder):
    return sorted(line.strip() for name in os.listdir(folder) if name.startswith("calls") for line in open(os.path.join(folder, name)))


def test_a_second_run_asks_only_what_is_open(spark, tmp_path):
    texts = {i: f"text {i % 9}" for i in range(12)} | {50: None}
    run = lambda fail: JudgeRun(str(tmp_path / "run"), slices=3).responses(transcripts_of(spark, texts), counting(str(tmp_path), fail))
    got = {r.conversation_id: (r.response, r.error) for r in run(lambda t: t in ("text 2", "text 5")).collect()}
    assert got[50] == (None, judge.TOO_LONG) and got[2] == got[11] == (None, "no answer") and got[3][0]
    assert calls(tmp_path) == sorted(f"text {i}" for i in range(9))  # equal prompts once
    again = {r.conversation_id: (r.response, r.error) for r in run(lambda t: False).collect()}
    assert calls(tmp_path) == sorted([*(f"text {i}" for i in range(9)), "text 2", "text 5"])
    assert all(v == ('{"quality": 3}', None) for k, v in again.items() if k != 50)


def test_a_task_that_runs_again_pays_once(spark, tmp_path):
    """The slice dies after some answers; what it was told is not asked for again."""
    texts = {i: f"text {i}" for i in range(10)}
    folder, run = str(tmp_path), str(tmp_path / "run")
    inner = counting(folder)

    def dying(question):
        told = [line for name in os.listdir(folder) if name.startswith("calls") for line in open(os.path.join(folder, name))]
        if len(told) >= 4:
            os._exit(1)  # the executor is lost
        return inner(question)

    with pytest.raises(Exception):
        JudgeRun(run, slices=1).responses(transcripts_of(spark, texts), dying)
    assert len(calls(folder)) == 4
    got = JudgeRun(run, slices=1).responses(transcripts_of(spark, texts), inner).collect()
    assert calls(folder) == sorted(texts.values()) and all(r.response for r in got)
    assert not os.path.exists(f"{run}/journal/slice=0")


def test_a_note_that_was_cut_off_is_skipped(tmp_path):
    journal = Journal(str(tmp_path / "notes"))
    assert journal.known() == {}
    journal.note({"a": "1"})
    (tmp_path / "notes" / "half").write_text('{"b": "2')
    assert journal.known() == {"a": "1"}
    journal.clear()
    journal.clear()
    assert journal.known() == {}
