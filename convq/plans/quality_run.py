"""The two quality runs: classic over a sample, stratified over even segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from convq import schema as s
from convq.functions.rules import CLASSIC, OPTIMIZED, Profile
from convq.operators import filters as f
from convq.operators import joins, quality, reports, rollup, sampling
from convq.sources import sinks
from convq.sources.workspace import stored


@dataclass
class QualityRun:
    """Written flags of one run; every report below reads these small rows."""

    flags: DataFrame
    method: str
    sample_rate: float = 1.0
    start: str = s.START_DATE
    end: str = s.END_DATE

    def reports(self) -> dict[str, DataFrame]:
        # written once each: the eleven tables below derive from them
        metrics = stored(reports.quality_metrics(self.flags), "metrics")
        segments = stored(reports.stratified_metrics(self.flags), "segments")
        usable = stored(quality.usable_conversations(self.flags), "usable")
        tables = {
            "summary": reports.run_summary(
                metrics, self.start, self.end, self.method, self.sample_rate
            ),
            "quality_issues": reports.issue_report(metrics),
            "issue_flag_counts": reports.issue_flag_counts(self.flags),
            "usable_percentage": reports.usable_percentage(metrics),
            "usable_by_time": reports.usable_by_time(self.flags),
            "stratified_metrics": segments,
            "usability_matrix": reports.usability_matrix(segments),
            "usable_by_length": reports.usable_by_length(segments),
            "top_segments": reports.top_segments(segments),
            "recommended_segments": reports.recommended_segments(segments),
            "usable_segment_counts": reports.usable_segment_counts(usable),
        }
        if self.sample_rate < 1.0:
            tables["projection"] = reports.projection(metrics, self.sample_rate)
        return tables

    def save(self, path: str) -> None:
        for name, table in self.reports().items():
            sinks.write_json_report(table, f"{path}/{name}")
        sinks.write_usable_ids(quality.usable_conversations(self.flags), f"{path}/usable_ids")


def written_flags(messages: DataFrame, path: str, profile: Profile) -> DataFrame:
    """Flags as a table, by way of a table of message features.

    The text is read once, and again only for conversations that may be duplicates; the rest
    works on narrow rows, and a lost executor costs one step, not the whole run.
    """
    spark = messages.sparkSession
    features = quality.message_features(messages, profile)
    features.write.mode("overwrite").parquet(f"{path}/features")
    flags = quality.flags_from_features(spark.read.parquet(f"{path}/features"), messages, profile)
    flags.write.mode("overwrite").parquet(f"{path}/flags")
    return spark.read.parquet(f"{path}/flags")


def stratified_run(
    messages: DataFrame,
    path: str,
    target: int = 1_000_000,
    profile: Profile = OPTIMIZED,
    seed: int = sampling.SEED,
) -> QualityRun:
    """Even sample over buckets and length classes; whole conversations are judged."""
    ids = sampling.stratified_sample(messages, target, seed)
    sampled = joins.fetch_by_ids(messages, ids)
    flags = written_flags(sampled, path, profile)
    return QualityRun(flags, "even strata")


def classic_run(
    messages: DataFrame,
    path: str,
    sample_rate: float | None = None,
    limit: int | None = None,
    sample_by: str = "conversation",
    two_sided: bool = False,
    profile: Profile = CLASSIC,
    start: str = s.START_DATE,
    end: str = s.END_DATE,
    seed: int = sampling.SEED,
) -> QualityRun:
    """All conversations in range, a share of them, or a fixed number of them."""
    in_range = f.date_range_filter(messages, start, end)
    pool = in_range
    if two_sided:
        pool = joins.fetch_by_ids(in_range, rollup.two_sided_conversations(messages, start=start, end=end))
    chosen, rate = pool, 1.0
    if limit is not None:
        chosen = joins.fetch_by_ids(pool, sampling.random_conversations(pool, limit, seed))
    elif sample_rate is not None:
        rate = sample_rate
        chosen = joins.fetch_by_ids(
            pool, sampling.percent_sample(pool, sample_rate, sample_by, seed)
        )
    flags = written_flags(chosen, path, profile)
    if limit is not None:
        # the share that was really drawn, so that projections fit
        drawn = flags.count()
        total = rollup.distinct_conversations(pool).first()["n_conversations"]
        rate = drawn / total if total else 1.0
    return QualityRun(flags, "sample" if rate < 1.0 else "full", rate, start, end)


def stored_run(
    metadata: DataFrame, messages: DataFrame, path: str, profile: Profile = OPTIMIZED
) -> QualityRun:
    """The stratified reports over a stored copy."""
    kept = joins.fetch_by_ids(messages, metadata)
    return QualityRun(written_flags(kept, path, profile), "stored copy")
