"""Judge runs that can stop at any point and go on, and that pay for each prompt once.

Answers are kept by the hash of their prompt.  A run deals the prompts over slices; before each slice those
that are answered already are left out, and its answers are appended as a table, in one step, at its end.
What a task has been told inside a slice is noted at once, in a journal of small files that all
executors reach, and a task that runs again, after a lost executor or in a later run, looks there first.
Once the slice is in the table its notes are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from convq.functions import judge, slices

SLICES = 4
ANSWER = "key string, response string, error string"


class Journal:
    """Notes of answers below ``folder``, a local path or a URI that pyarrow can open on every executor."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def known(self) -> dict[str, str]:
        """Answers by key; notes that were cut off while they were written are skipped."""
        files, path = self._open()
        found: dict[str, str] = {}
        for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            try:
                found |= json.loads(files.open_input_file(info.path).read())
            except ValueError:
                continue
        return found

    def note(self, answers: dict[str, str]) -> None:
        files, path = self._open()
        files.create_dir(path)
        with files.open_output_stream(f"{path}/{uuid.uuid4().hex}") as out:
            out.write(json.dumps(answers).encode())

    def clear(self) -> None:
        files, path = self._open()
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_dir(path)


def _ask(questions: DataFrame, scorer: judge.Scorer, batched: bool, journal: Journal) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = journal.known() if known is None else known
            for start, end in slices.bounds(batch.column("prompt")):
                part = batch.slice(start, end - start)
                pairs = list(zip(part.column("key").to_pylist(), part.column("prompt").to_pylist()))
                rows = [(key, known[key], None) for key, _ in pairs if key in known]
                open_ = [(key, question) for key, question in pairs if key not in known]
                keys = iter([key for key, _ in open_])
                for answers, errors in judge.answers_to([question for _, question in open_], scorer, batched) if open_ else ():
                    asked = [(next(keys), answer, error) for answer, error in zip(answers, errors)]
                    rows += asked
                    good = {key: answer for key, answer, _ in asked if answer is not None}
                    if good:
                        journal.note(good)
                columns = [pa.array(column, pa.string(), from_pandas=True) for column in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "response", "error"])

    return questions.select("key", "prompt").mapInArrow(ask, ANSWER)


class JudgeRun:
    """The answers below ``path``; make it anew with the same path to go on with a run that stopped."""

    def __init__(self, path: str, slices: int = SLICES):
        self.path = path.rstrip("/")
        self.slices = slices

    def _answers(self, spark) -> DataFrame | None:
        """The best answer to each prompt: a response if there is one, else an error."""
        try:
            rows = spark.read.schema(ANSWER).parquet(f"{self.path}/answers")
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        best = F.max(F.struct(F.col("response").isNotNull().alias("good"), "response", "error")).alias("best")
        return rows.groupBy("key").agg(best).select("key", "best.response", "best.error")

    def responses(
        self, transcripts: DataFrame, scorer: judge.Scorer, text: str = "full_conversation", batched: bool = False
    ) -> DataFrame:
        """``conversation_id, response, error`` like ``judge.judge_responses``, asking only what is not answered yet.

        Equal prompts are asked once.  Prompts that failed are asked again by the next run.  Runs one job
        per slice that has open prompts.
        """
        spark = transcripts.sparkSession
        question = judge.prompt(F.col(text))
        work = f"{self.path}/prompts-{uuid.uuid4().hex}"
        keyed = transcripts.select("conversation_id", question.alias("prompt"), F.sha2(question, 256).alias("key"))
        keyed.write.parquet(f"{work}/all")
        keyed = spark.read.parquet(f"{work}/all")
        slice_ = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), F.lit(self.slices)).cast("int")
        asked = keyed.filter("prompt is not null").dropDuplicates(["key"]).withColumn("slice", slice_)
        asked.write.partitionBy("slice").parquet(f"{work}/asked")
        asked = spark.read.schema("key string, prompt string, slice int").parquet(f"{work}/asked")
        for k in range(self.slices):
            open_ = asked.filter(F.col("slice") == k)
            answered = self._answers(spark)
            if answered is not None:
                open_ = open_.join(answered.filter("response is not null").select("key"), "key", "left_anti")
            if open_.isEmpty():
                continue
            journal = Journal(f"{self.path}/journal/slice={k}")
            _ask(open_, scorer, batched, journal).write.mode("append").parquet(f"{self.path}/answers")
            journal.clear()
        answered = self._answers(spark)
        if answered is None:
            answered = spark.createDataFrame([], ANSWER)
        found = keyed.select("conversation_id", "key").join(answered, "key", "left")
        error = F.when(F.col("key").isNull(), judge.TOO_LONG).otherwise(F.col("error"))
        return found.select("conversation_id", "response", error.alias("error"))
