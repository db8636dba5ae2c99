"""Sample conversations, drop unreadable ones, have the rest judged, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame

from convq.functions import judge
from convq.operators import filters as f
from convq.operators import joins, reports, sampling, transcripts
from convq.plans.judge_run import JudgeRun
from convq.sources import sinks


def sampled_transcripts(
    messages: DataFrame, n: int = 10, seed: int = sampling.SEED, first: int | None = None
) -> DataFrame:
    """Authored transcripts of ``n`` random conversations, of their ``first`` messages if given."""
    ids = sampling.random_conversations(messages, n, seed)
    return transcripts.transcript_authored(joins.fetch_by_ids(messages, ids), first)


def filter_and_judge(
    messages: DataFrame,
    scorer: judge.Scorer,
    path: str,
    n: int = 10,
    seed: int = sampling.SEED,
    first: int | None = None,
) -> dict[str, DataFrame]:
    """Run the whole job; every answer is kept, and a run over the same ``path`` goes on where one stopped."""
    spark = messages.sparkSession
    sampled = sampled_transcripts(messages, n, seed, first)
    sinks.write_json_report(sampled, f"{path}/sampled_conversations")  # for inspection
    stored = spark.read.schema(sampled.schema).json(f"{path}/sampled_conversations")
    answers = JudgeRun(f"{path}/judge").responses(f.prefilter(stored), scorer)
    answers.write.mode("overwrite").parquet(f"{path}/responses")
    verdicts, errors = judge.split_verdicts(spark.read.parquet(f"{path}/responses"))
    sinks.append_verdicts(verdicts, f"{path}/verdicts")
    result = {
        "judge_summary": reports.judge_summary(verdicts),
        "judge_distribution": reports.judge_distribution(verdicts),
        "errors": errors,
    }
    for name, table in result.items():
        sinks.write_json_report(table, f"{path}/{name}")
    return result | {"verdicts": verdicts}
