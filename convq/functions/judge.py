"""Prompts for a judge, its verdict text, and a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convq.functions import slices
from convq.functions import text as tx
from convq.schema import VERDICT_SCHEMA

# ---- fixed values: the prompt around the conversation ----
PROMPT_HEAD = """You are an expert conversation evaluator for large language model training. Your task is to analyze conversations between users and AI assistants to determine their suitability for LLM fine-tuning.

IMPORTANT: Your response MUST be a valid JSON object. Do not include backticks, markdown code block markers, or any other text outside the JSON object.

[CONVERSATION]
"""
PROMPT_TAIL = """
[END CONVERSATION]

Evaluate this conversation and return a JSON object with these fields:

- quality (integer 1-10): The overall quality of the conversation for fine-tuning.
- topic (string): The main subject from the provided list.
- summary (string): A concise 10-20 word description.
- classification_reasoning (string): Brief reasoning for the quality and safety classifications.
- contains_pii (boolean): True if PII is present.
- contains_sensitive_content (boolean): True if PHI or other sensitive topics are present.
- is_safe (boolean): True if the conversation contains NO harmful material.
- response_accuracy (string): "high" | "medium" | "low".
- ai_assistant_is_wrong (boolean): True if the assistant is clearly incorrect.
- language (string): The primary language used."""
# ---- end of fixed values ----

TOO_LONG = "the conversation is too long for a prompt"
RESPONSE = "conversation_id {id_type}, response string, error string"


def prompt(conversation: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), conversation, F.lit(PROMPT_TAIL))


def clean_verdict(response: Column) -> Column:
    """The JSON text inside an answer: without outer space and code fences."""
    body = tx.strip(response)
    body = F.when(body.startswith("```json"), F.substr(body, F.lit(8))).otherwise(body)
    body = F.when(body.startswith("```"), F.substr(body, F.lit(4))).otherwise(body)
    end = F.length(body) - 3
    return F.when(body.endswith("```"), F.substr(body, F.lit(1), end)).otherwise(body)


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """Responses with the verdict's fields; ``corrupt`` tells which could not be read.

    An answer is parsed once, its fields as text.  A field that is there but cannot be taken
    as its type makes the answer corrupt; a field that is missing or null stays null.
    """
    as_text = ", ".join(f"{field.name} string" for field in VERDICT_SCHEMA.fields) + ", broken string"
    # explode keeps the two steps apart: merged, the answer would be parsed for every field
    cleaned = responses.select("*", F.explode(F.array(tx.strip(clean_verdict(F.col("response"))))).alias("body"))
    given = F.from_json("body", as_text, {"columnNameOfCorruptRecord": "broken"})
    parsed = cleaned.select(
        *responses.columns,
        F.coalesce(F.col("body").startswith("{"), F.lit(False)).alias("is_object"),
        F.explode(F.array(given)).alias("given"),
    )
    values, wrong = {}, F.lit(False)
    for field in VERDICT_SCHEMA.fields:
        given, kind = F.col(f"given.{field.name}"), field.dataType.simpleString()
        value = given if kind == "string" else given.try_cast(kind)
        if kind == "boolean":
            value = F.when(given.isin("true", "false"), value)
        values[field.name] = value
        wrong = wrong | (value.isNull() & given.isNotNull())
    corrupt = ~F.col("is_object") | F.col("given.broken").isNotNull() | wrong
    return parsed.select(
        *responses.columns, corrupt.alias("corrupt"), *[value.alias(name) for name, value in values.items()]
    )


Scorer = Callable[[str], str] | Callable[[list[str]], list[str]]


def answers_to(questions: list[str], scorer: Scorer, batched: bool) -> Iterator[tuple[list[str | None], list[str | None]]]:
    """Answers and errors, one of each per question, as they come in: one by one, or all of a batch together."""
    if not batched:
        for question in questions:
            try:
                yield [scorer(question)], [None]
            except Exception as problem:
                yield [None], [str(problem)]
        return
    try:
        answers = list(scorer(questions))
        if len(answers) != len(questions):
            raise ValueError(f"{len(answers)} answers to {len(questions)} prompts")
        yield answers, [None] * len(answers)
    except Exception as problem:
        yield [None] * len(questions), [str(problem)] * len(questions)


def judge_responses(
    transcripts: DataFrame, scorer: Scorer, text: str = "full_conversation", batched: bool = False
) -> DataFrame:
    """Ask ``scorer(prompt)`` for every conversation; a failure becomes an error row.

    A ``batched`` scorer gets the prompts of a slice of an Arrow batch (see ``slices``) as a list,
    to send them together, and returns as many answers; if it fails, so does each of them.  A
    conversation whose text is null, being too long for a cell, is not asked about: it is an error
    row.  A task holds the prompts and answers of one slice, whatever the size of its batches.

    Scorer calls cost money and run again when an executor is lost; ``plans.judge_run`` keeps every
    answer and asks once.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for start, end in slices.bounds(texts, len(PROMPT_HEAD + PROMPT_TAIL)):
                prompts = [None if t is None else PROMPT_HEAD + t + PROMPT_TAIL for t in texts.slice(start, end - start).to_pylist()]
                yield _answered(ids.slice(start, end - start), prompts)

    def _answered(ids: pa.Array, prompts: list[str | None]) -> pa.RecordBatch:
        known = [p for p in prompts if p is not None]
        found = list(answers_to(known, scorer, batched)) if known else []
        answers, errors = iter([a for some, _ in found for a in some]), iter([e for _, some in found for e in some])
        rows = [(None, TOO_LONG) if p is None else (next(answers), next(errors)) for p in prompts]
        texts = [pa.array(column, pa.string(), from_pandas=True) for column in zip(*rows)]
        return pa.RecordBatch.from_arrays([ids, *texts], ["conversation_id", "response", "error"])

    id_type = transcripts.schema["conversation_id"].dataType.simpleString()
    asked = transcripts.select("conversation_id", F.col(text).alias("text"))
    return asked.mapInArrow(ask, RESPONSE.format(id_type=id_type))


def split_verdicts(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, errors): failed and unreadable answers go to the second frame."""
    parsed = parse_verdicts(responses)
    failed = F.col("error").isNotNull() | F.col("corrupt")
    verdicts = parsed.filter(~failed).drop("response", "error", "corrupt")
    errors = parsed.filter(failed).select(
        "conversation_id", "response", F.coalesce("error", F.lit("not a JSON object")).alias("error")
    )
    return verdicts, errors
