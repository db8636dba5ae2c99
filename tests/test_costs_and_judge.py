import json

import pytest
from pyspark.sql import functions as F

from convq.functions import judge
from convq.functions import tokens as tk
from convq.operators import costs, reports
from convq.plans.filter_judge import filter_and_judge
from convq.plans.token_cost import token_cost_run
from convq.sources import sinks


def test_price_of_a_million_tokens(spark):
    rows = spark.createDataFrame([("short", 100_000, 400_000, 4)] * 10, "length_category string, token_count bigint, char_count bigint, message_count bigint")
    breakdown = costs.cost_breakdown(costs.token_stats(rows))
    summary = costs.cost_summary(breakdown).first()
    assert summary.total_tokens == 1_000_000 and summary.total_conversations == 10
    assert summary.total_cost_usd == pytest.approx(0.8568)
    assert breakdown.agg(F.sum("estimated_cost_usd")).first()[0] == pytest.approx(summary.total_cost_usd)
    assert summary.avg_cost_per_conversation == pytest.approx(0.08568)


def test_token_rows_need_no_transcript(make):
    m = make({1: ["abc", "defg", None, "hi"], 2: ["a", "b"], 3: ["word " * 30] * 25})
    got = {r.conversation_id: (r.length_category, r.char_count, r.token_count) for r in costs.token_rows(m).collect()}
    assert got == {1: ("short", 12, 3), 3: ("long", 150 * 25 + 24, (150 * 25 + 24) // 4)}


def test_tokenizer_and_its_fallback(spark, make):
    m = make({1: ["one two", "three", "four five"], 2: ["bad words here", "x", "y"]})

    def words(texts):
        if any("bad" in t for t in texts):
            raise ValueError("cannot read this")
        return [t.split() for t in texts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        rows = costs.token_rows(m, tk.tokenizer_counts(words)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.conversation_id: r.token_count for r in rows} == {1: 5, 2: len("bad words here x y") // 4}
    assert {r.conversation_id: r.estimated_parts for r in rows} == {1: 0, 2: 1}


def test_long_conversations_are_counted_whole_in_parts(make):
    m = make({1: ["some words here"] * 40, 2: ["a b", "c d e", "f " * 300]})
    words = tk.tokenizer_counts(lambda texts: [t.split() for t in texts])
    whole, parts = (
        {r.conversation_id: r.token_count for r in costs.token_rows(m, words, part_chars=n).collect()} for n in (1 << 20, 50)
    )
    assert whole == parts == {1: 120, 2: 305}


def test_words_and_marks(spark):
    df = spark.createDataFrame([("Hello, world! it's",), ("",), ("  ",), ("é ü",)], "t string")
    got = [r[0] for r in df.select(tk.count_words_and_marks(F.col("t"))).collect()]
    assert got == [7, 0, 0, 2]


def test_token_cost_run_writes_all_tables(spark, make, tmp_path):
    m = make({1: ["abc", "defg", "hi"], 2: ["text here"] * 8})
    result = token_cost_run(m, str(tmp_path))
    assert result["token_stats"].count() == 2
    for name in ("tokens", "token_stats", "cost_breakdown", "cost_summary"):
        assert spark.read.option("header", True).csv(f"{tmp_path}/{name}").count() > 0


GOOD = {"quality": 7, "is_safe": True, "contains_pii": False, "language": "en", "response_accuracy": "high"}


def test_verdict_forms(spark):
    body = json.dumps(GOOD)
    answers = {
        1: body,
        2: f"```json\n{body}\n```",
        3: f"```{body}```",
        4: f"  \n```json{body}``` \n",
        5: body[:-1],
        6: "[1]",
        7: "",
        8: None,
        9: "{}",
        10: f"```json```json{body}```",
        11: json.dumps(GOOD | {"quality": "very good"}),
        12: json.dumps(GOOD | {"is_safe": 3}),
        13: json.dumps(GOOD | {"topic": None}),
    }
    df = spark.createDataFrame([(k, v, None) for k, v in answers.items()], "conversation_id int, response string, error string")
    verdicts, errors = judge.split_verdicts(df)
    got = {r.conversation_id: r.quality for r in verdicts.collect()}
    assert got == {1: 7, 2: 7, 3: 7, 4: 7, 9: None, 13: 7}
    assert {r.conversation_id for r in errors.collect()} == {5, 6, 7, 8, 10, 11, 12}


def test_prompt_encloses_the_conversation(spark):
    text = spark.range(1).select(judge.prompt(F.lit("A: hi"))).first()[0]
    assert text.startswith("You are an expert") and "[CONVERSATION]\nA: hi\n[END CONVERSATION]" in text


def test_filter_and_judge_keeps_going_after_a_failure(spark, make, tmp_path):
    texts = "a readable text with letters and even more letters in it, number "
    m = make({i: [texts + str(i), "answer " + texts] for i in range(20)} | {99: ["1", "2"]})

    def scorer(question):
        if "number 7" in question:
            raise RuntimeError("no answer")
        return json.dumps(GOOD)

    for _ in range(2):
        result = filter_and_judge(m, scorer, str(tmp_path / "run"), n=21)
    assert result["judge_summary"].first().total_conversations == 19
    assert [r.error for r in result["errors"].collect()] == ["no answer"]
    assert spark.read.json(str(tmp_path / "run/verdicts")).count() == 38  # both runs
    assert spark.read.json(str(tmp_path / "run/sampled_conversations")).count() == 21


def test_summary_of_missing_columns_is_zero(spark):
    df = spark.createDataFrame([(1, "en"), (2, None)], "conversation_id int, language string")
    row = reports.judge_summary(df).first()
    assert (row.total_conversations, row.quality_mean, row.safe_conversations) == (2, 0, 0)
    assert [tuple(r) for r in reports.judge_distribution(df).collect()] == [("language", "en", 1)]


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("short", 1), ("long", 2)], "length_category string, n int")
    sinks.write_csv(df, str(tmp_path / "c"), partition_by="length_category")
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"length_category=short", "length_category=long"}
    for _ in range(2):
        sinks.write_json_report(df, str(tmp_path / "j"))
        sinks.append_verdicts(df, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert spark.read.json(str(tmp_path / "v")).count() == 4


def test_batched_scorer(spark):
    df = spark.createDataFrame([(i, "text") for i in range(6)], "conversation_id int, full_conversation string").coalesce(1)
    asked = judge.judge_responses(df, lambda prompts: ["{}"] * len(prompts), batched=True)
    assert [r.response for r in asked.collect()] == ["{}"] * 6
    short = judge.judge_responses(df, lambda prompts: ["{}"], batched=True).collect()
    assert len(short) == 6 and all("1 answers to 6" in r.error for r in short)


MOST = 2 << 20  # bytes that a tokenizer or a judge is handed at once


def test_a_tokenizer_gets_a_batch_in_slices(spark):
    def words(texts):
        if sum(map(len, texts)) > MOST:
            raise MemoryError("too many texts at once")
        return [t.split() for t in texts]

    texts = [("word " * 40_000,), (None,), ("",)] * 20 + [("a" * (3 * MOST),)]
    df = spark.createDataFrame(texts, "text string").coalesce(1)
    got = [tuple(r.c) for r in df.select(tk.tokenizer_counts(words)("text").alias("c")).collect()]
    assert got == [(40_000, False), (0, False), (0, False)] * 20 + [(3 * MOST // 4, True)]


def test_a_judge_gets_a_batch_in_slices(spark):
    def scorer(prompts):
        if sum(map(len, prompts)) > MOST:
            raise MemoryError("too many prompts at once")
        return [str(len(p)) for p in prompts]

    frame = len(judge.PROMPT_HEAD + judge.PROMPT_TAIL)
    rows = [(i, None if i % 10 == 3 else "é" * (i % 10) * 5000) for i in range(300)]
    df = spark.createDataFrame(rows, "conversation_id int, full_conversation string").coalesce(1)
    got = {r.conversation_id: (r.response, r.error) for r in judge.judge_responses(df, scorer, batched=True).collect()}
    assert got == {i: (None, judge.TOO_LONG) if t is None else (str(len(t) + frame), None) for i, t in rows}


def test_a_resumed_judge_gets_a_batch_in_slices(spark, tmp_path):
    from convq.plans.judge_run import JudgeRun

    def scorer(prompts):
        if sum(map(len, prompts)) > MOST:
            raise MemoryError("too many prompts at once")
        return ["{}"] * len(prompts)

    rows = [(i, f"{i} " + "word " * 10_000) for i in range(100)]
    df = spark.createDataFrame(rows, "conversation_id int, full_conversation string").coalesce(1)
    got = JudgeRun(str(tmp_path / "run"), 1).responses(df, scorer, batched=True).collect()
    assert [r.response for r in got] == ["{}"] * 100
